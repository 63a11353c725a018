"""Structured Streaming counterparts of the event queries."""
