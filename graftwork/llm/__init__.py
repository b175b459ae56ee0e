"""Operators for large text corpora: deduplication, scoring, tokens, archives, search."""
