"""Streams of pairs and events."""
