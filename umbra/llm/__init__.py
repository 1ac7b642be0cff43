"""Operators for training-data pipelines: packing, near-duplicates, personal data, repeats, licences, secrets, quality."""
