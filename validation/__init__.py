"""Queries over the test tables and the same answers in SQL."""
