"""Batch document retrieval and specification analytics on Spark."""
