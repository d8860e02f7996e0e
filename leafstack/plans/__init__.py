"""Queries on the tables of a folder, with the SQL that gives the same rows."""
