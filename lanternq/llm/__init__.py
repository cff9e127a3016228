"""Operators for preparing training data at scale, each a DataFrame to DataFrame function."""
