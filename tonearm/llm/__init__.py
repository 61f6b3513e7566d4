"""Operators for preparing text and embedding corpora for model training."""
