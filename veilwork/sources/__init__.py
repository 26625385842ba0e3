"""Input readers, store-table schemas and sinks."""
