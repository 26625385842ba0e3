"""Operators of a training-data pipeline, each a module with its query in ``queries``."""
