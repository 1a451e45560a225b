"""Streaming ingestion into tables."""
