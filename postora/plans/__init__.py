"""The query language: trees, their parser and their compilation to DataFrames."""
