"""Quantile operators and summaries."""
