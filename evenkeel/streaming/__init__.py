"""Structured Streaming forms of the metrics and the rule assignment."""
