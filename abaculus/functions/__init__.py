"""Scalar functions: every one maps columns to a column."""
