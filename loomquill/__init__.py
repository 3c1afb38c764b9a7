"""A PySpark-native engine for turning conversation transcripts into bounded chunks and a curated knowledge base."""

__version__ = "0.1.0"
