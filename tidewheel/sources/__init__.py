"""Readers, ingest mapping and upsert."""
