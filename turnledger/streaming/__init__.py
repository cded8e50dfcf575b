"""Structured Streaming legs."""
