"""Structured Streaming jobs: coverage monitoring and the escalation log."""
