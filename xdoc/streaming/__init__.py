"""Streaming analytics on documents."""
