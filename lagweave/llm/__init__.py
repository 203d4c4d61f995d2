"""Operators over text corpora for preparing training data."""
