"""Spatial, evaluation, split and clustering operators."""
