"""Readers and writers for tables, manifests, media files and reports."""
