"""Corpus search and analytics on Spark."""
