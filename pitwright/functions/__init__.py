"""Scalar functions and checks."""
