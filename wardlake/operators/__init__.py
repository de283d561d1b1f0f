"""Operators: DataFrame in, DataFrame out, all lazy."""
