"""Preparation of training data from free-text records: duplicates, personal data, formatting, extraction, packing, filters."""
