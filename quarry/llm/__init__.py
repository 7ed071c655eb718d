"""Corpus operators for training-data pipelines: de-duplication, scoring, packing,
tokenising, filtering and redaction.  Nothing else in the library imports this package."""
