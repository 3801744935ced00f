"""Weighted-vector search, clustering and text vectorisation as Spark DataFrame plans."""
