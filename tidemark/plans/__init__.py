"""Named views over the marks, and the SQL they are checked with."""
