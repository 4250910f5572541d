"""Readers of exported artifacts: every one returns a record table with its ingest ordinal."""
