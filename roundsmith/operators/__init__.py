"""Relational operators over domain tables."""
