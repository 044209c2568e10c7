"""Tesserae: a Spark-first engine for retrieval, relational and corpus processing."""

__version__ = "0.1.0"
