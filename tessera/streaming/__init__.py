"""Streaming forms of the lifecycle."""
