"""Readers of line-delimited and marked-up text."""
