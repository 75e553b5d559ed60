"""Queries over stored tables, and the SQL that gives the same rows."""
