"""Quire: page decoding results to a structured, queryable corpus, on Spark DataFrames."""
