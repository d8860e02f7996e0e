"""Queries over listings, archives, pages and feeds as PySpark DataFrames."""
