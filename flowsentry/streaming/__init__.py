"""Structured Streaming deploy scorer."""
