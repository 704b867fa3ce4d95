"""Summaries that Structured Streaming maintains."""
