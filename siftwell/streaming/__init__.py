"""Structured Streaming: change streams and merge-on-read upkeep."""
