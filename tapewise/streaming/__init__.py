"""Structured Streaming jobs: ingest, deduplication, activity, hourly equity, behavior watch."""
