"""Structured Streaming around the log: capture into it, consumers and sinks out of it."""
