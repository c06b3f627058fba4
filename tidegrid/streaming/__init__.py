"""Keyed state for Structured Streaming."""
