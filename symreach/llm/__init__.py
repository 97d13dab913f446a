"""Operators for large-scale training data; nothing else in symreach imports this subpackage."""
