"""Operators: plain functions from DataFrames to a DataFrame, nothing eager
except where a docstring says so."""
