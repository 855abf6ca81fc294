"""Relational operators over DataFrames with the dialect's semantics."""
