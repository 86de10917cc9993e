"""Column functions and fixed lexicons."""
