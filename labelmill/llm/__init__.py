"""Operators for preparing language-model training data, one module each."""
