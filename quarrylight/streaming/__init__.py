"""Structured Streaming modes."""
