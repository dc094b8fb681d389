"""Structured Streaming twins of the event-driven operators."""
