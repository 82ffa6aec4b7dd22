"""Relational operators of the document engine; each takes and returns DataFrames."""
