"""Operators over DataFrames of entries, nodes and events."""
