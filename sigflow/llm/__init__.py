"""Operators of a training-data pipeline: deduplication, tokenisation,
licence scans, search, packing, language identification, chat formatting and
language-model scoring. Nothing else in the library imports this package."""
