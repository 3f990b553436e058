"""Operators for preparing training data: filters, deduplication, search, mixing, packing and token counts."""
