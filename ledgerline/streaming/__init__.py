"""Structured Streaming: file-arrival ingestion."""
