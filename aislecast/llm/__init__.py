"""Corpus operators for training data: privacy, deduplication, tokens, web pages, search."""
