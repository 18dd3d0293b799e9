"""Corpus preparation, linguistic features and group statistics as Spark DataFrame jobs."""
