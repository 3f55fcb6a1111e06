"""Operators that prepare training text: deduplication, quality, mixing, tokenization, scoring."""
