"""Structured Streaming forms of the live path."""
