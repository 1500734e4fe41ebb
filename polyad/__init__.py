"""Tensor analytics on Spark DataFrames: an N-way array is a coordinate table or a table of dense blocks."""
