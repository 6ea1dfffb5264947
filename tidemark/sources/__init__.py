"""Readers: bulk tables, tagged facts, printed schedules, universe and rate files, and the test tables."""
