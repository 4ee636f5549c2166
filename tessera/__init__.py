"""Hybrid retrieval and analytics over document collections, as plain Spark plans."""
