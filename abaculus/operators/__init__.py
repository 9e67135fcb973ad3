"""Ledger operators: DataFrames and settings in, DataFrames out."""
