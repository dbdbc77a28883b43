"""Relational operators of the linkage engine: DataFrame in, DataFrame out."""
