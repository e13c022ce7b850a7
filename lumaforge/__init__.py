"""Batch analytics over image corpora, written as PySpark DataFrame jobs."""
