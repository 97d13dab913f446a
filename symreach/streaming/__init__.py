"""Changes over time."""
