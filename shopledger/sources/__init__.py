"""Typed loading, adapters for the benchmark tables, and sinks."""
