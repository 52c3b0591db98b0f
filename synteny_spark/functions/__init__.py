"""Scalar functions, as columns and, where a kernel needs them, in Python."""
