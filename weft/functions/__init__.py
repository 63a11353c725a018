"""Scalar functions and user functions."""
