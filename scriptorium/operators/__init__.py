"""Relational operators that need more than one expression."""
