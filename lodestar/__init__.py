"""Corpus intake, profiling and content-schema analytics on Spark."""
