"""Operators over DataFrames: full text, vectors, fusion, scoring, facets, relations, segments."""
