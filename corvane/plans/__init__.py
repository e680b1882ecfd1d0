"""Whole runs made of the operators: indexing and searching."""
