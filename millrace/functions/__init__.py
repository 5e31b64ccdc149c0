"""Scalar functions and operators of expressions."""
