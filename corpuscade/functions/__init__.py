"""Scalar functions: built-in column expressions first, Arrow-batched functions where none exists."""
