"""Structured Streaming: windows on event time, and a rate limiter with keyed state."""
