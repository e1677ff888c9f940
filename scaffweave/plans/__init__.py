"""Whole runs, and the operators over the given tables."""
