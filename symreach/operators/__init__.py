"""Relational operators on symbol graphs."""
