"""Column functions and constants."""
