"""Structured Streaming forms of event routing, rules and feedback counters."""
