"""Operators for large text corpora used to train language models (problems 1 to 10)."""
