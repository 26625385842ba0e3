"""Structured Streaming versions of the anonymise, mapping and alarm jobs."""
