"""Queries over the given test tables, one per operator, and the SQL they are checked against."""
