"""Column functions: paths, globs, text and vectors."""
