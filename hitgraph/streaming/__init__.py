"""Streaming aggregates; an extra of this engine."""
