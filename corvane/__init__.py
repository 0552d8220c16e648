"""Corvane: governed-retrieval analytics on PySpark."""
