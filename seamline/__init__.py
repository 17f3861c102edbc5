"""Retrieval and data-processing engine over repository indexes, on PySpark."""
