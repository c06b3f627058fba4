"""Scalar functions, as columns."""
