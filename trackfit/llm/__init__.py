"""Operators for training-data corpora: documents, conversations and their tokens."""
