"""Operators for large training-data corpora, written for Spark.

Nothing else in the library imports this subpackage, so it can be removed.
"""
