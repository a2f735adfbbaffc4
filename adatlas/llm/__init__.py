"""Operators for preparing text collections as training data, one module each."""
