"""Structured Streaming twins of the long-lived operators."""
