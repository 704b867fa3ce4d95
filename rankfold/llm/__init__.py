"""Operators of a training-data pipeline: licence scans, extraction, deduplication, joins, chat, quality, BPE, packing.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general interface;
``queries.py`` holds the thin ``opN_<name>`` queries over the intended tables and ``oracles.py`` their SQL.
"""
