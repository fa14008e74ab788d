"""Relational operators over pages."""
