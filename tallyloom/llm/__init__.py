"""Operators for building text corpora. Nothing outside this package imports it."""
