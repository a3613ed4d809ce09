"""Operators for large text corpora: tokenizing, scoring, deduplicating, redacting and packing documents."""
