"""Operators over registries, documents, chunks and events, as DataFrame expressions."""
