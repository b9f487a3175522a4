"""Readers, writers and first-look summaries."""
