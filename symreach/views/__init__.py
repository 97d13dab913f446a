"""Symbol graphs over tables that hold no source code, and queries on them."""
