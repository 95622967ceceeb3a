"""Relational operators over coverage tables."""
