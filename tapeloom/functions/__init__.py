"""Scalar helpers and statistics."""
