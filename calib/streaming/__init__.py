"""Structured Streaming versions of the reports."""
