"""Column functions: colour, geometry, headers, text forms."""
