"""Operators for preparing training text: tokenising, deduplication, scoring, redaction and packing."""
