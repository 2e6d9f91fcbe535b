"""Operators of a training-data pipeline (mixing, scoring, search, clean-up, output).

Nothing else in the library imports this package. Every operator is a function
over DataFrames; `queries.py` holds the thin registered queries.
"""
