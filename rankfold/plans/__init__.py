"""Pass planning, and the catalogue of queries."""
