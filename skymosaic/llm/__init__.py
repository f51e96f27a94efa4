"""Operators for preparing large text, vector and media corpora for model training."""
