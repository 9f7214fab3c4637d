"""Operators for training-data corpora. Nothing outside this subpackage depends on it."""
