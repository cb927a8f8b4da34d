"""Column functions: labels, vectors, text and set arithmetic."""
