"""Rank conventions and column functions."""
