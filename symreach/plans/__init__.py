"""Plug-ins as query plans."""
