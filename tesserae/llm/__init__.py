"""Operators for building training corpora: sharding, deduplication, quality, packing, tokenising, privacy."""
