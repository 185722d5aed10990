"""Compositions of operators: fixtures, indexing and storage."""
