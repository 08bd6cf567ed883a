"""Corpus operators for training-data preparation, each a Spark job over a ``documents``-like table.

Nothing else in the library imports this subpackage; it can be removed without touching the rest.
"""
