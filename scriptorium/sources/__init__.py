"""Readers of tables."""
