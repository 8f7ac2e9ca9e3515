"""Streaming counterparts of the append-only tables."""
