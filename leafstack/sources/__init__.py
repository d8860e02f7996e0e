"""Readers of listings, archives, pages and feeds."""
