"""Column functions: coercion of filed text and stable identities."""
