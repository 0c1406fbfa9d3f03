"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and column names and returns a DataFrame; :mod:`.queries` holds the
thin registered queries over the given tables.
"""
