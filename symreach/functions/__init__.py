"""Scalar functions on names, paths and patterns."""
