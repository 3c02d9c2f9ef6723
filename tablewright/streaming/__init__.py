"""Structured Streaming forms of the query log and the dashboard load."""
