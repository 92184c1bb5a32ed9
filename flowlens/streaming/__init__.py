"""Structured Streaming forms of scoring, alerting and intensity tracking."""
