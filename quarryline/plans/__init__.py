"""Whole pipelines: ingestion, retrieval and chat turns."""
