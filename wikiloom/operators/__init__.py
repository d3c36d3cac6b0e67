"""Operators of the knowledge base: DataFrame in, DataFrame out."""
