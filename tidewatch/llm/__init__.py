"""Operators for building training corpora on Spark."""
