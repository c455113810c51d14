"""Operators for preparing large training corpora: deduplication, scoring, filtering, packing."""
