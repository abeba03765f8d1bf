"""Summaries of streams."""
