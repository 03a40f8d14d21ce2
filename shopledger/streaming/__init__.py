"""Staging models over Structured Streaming."""
