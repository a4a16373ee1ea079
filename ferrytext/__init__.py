"""Spark jobs that localize large collections of documents."""
