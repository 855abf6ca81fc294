"""Scalar expressions and aggregates with the dialect's rules for types and nulls."""
