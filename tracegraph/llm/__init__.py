"""Operators for training-data pipelines: deduplication, language and quality models, extraction, archives, mixing."""
