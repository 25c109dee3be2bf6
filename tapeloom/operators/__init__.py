"""Operators: DataFrame in, DataFrame out; no actions, no session creation."""
