"""Queries over the test tables, by theme; each module has QUERIES and ORACLE."""
