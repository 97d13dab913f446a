"""Readers: Python source trees to tables."""
