"""Operators for preparing training data: scanning, deduplication, scoring, mixing, encoding, extraction."""
