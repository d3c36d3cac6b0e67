"""Readers: every table is a DataFrame with an explicit set of columns."""
