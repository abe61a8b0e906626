"""Readers that turn tables, directory trees, commit logs and transcripts into frames."""
