"""Column functions and the distribution functions that finish statistics."""
