"""Order statistics over large numeric columns: exact quantiles in a few passes, and the summaries that make them cheap."""
