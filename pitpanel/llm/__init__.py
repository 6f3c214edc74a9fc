"""Operators for training-data pipelines: token files, packing, quality, fixity, formatting,
near and exact duplicates, mixing, personal data, toxicity.

Every operator takes DataFrames and column names and returns a DataFrame. Null text counts as
empty; other nulls, ties, repeated rows and empty tables have the result each docstring states.
Columns beyond the named ones are ignored, whatever their names.
"""
