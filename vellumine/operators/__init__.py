"""Operators over entity DataFrames."""
