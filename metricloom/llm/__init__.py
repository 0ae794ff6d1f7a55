"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each operator module
exposes functions over DataFrames; ``queries`` registers the thin queries.
"""
