"""Scalar and aggregate functions as Column expressions."""
