"""Operators for large text collections: deduplication, search, language id, PII, WARC, mixing, LM scoring."""
