"""Operators chained into complete jobs."""
