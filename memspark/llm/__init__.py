"""Operators for preparing training text at scale: identification, deduplication, privacy, filters, tokens, packing, search."""
