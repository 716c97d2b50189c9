"""Structured Streaming over command logs."""
