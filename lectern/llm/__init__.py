"""Operators of a training-data pipeline: one module per operator, each a DataFrame → DataFrame
function with its own parameters; ``queries`` holds the thin registered queries.

Nothing else in the library imports this sub-package.
"""
