"""Operators for corpora of language-model training data."""
