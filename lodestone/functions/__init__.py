"""Scalar functions and model hooks."""
