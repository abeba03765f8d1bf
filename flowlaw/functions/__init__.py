"""Column functions: dictionary terms, metrics and spline bases."""
