"""Column functions and small row transforms."""
