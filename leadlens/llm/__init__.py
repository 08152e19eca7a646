"""Operators for a training-data pipeline over the ``documents`` table.

Nothing else in the library imports this package; ``queries.py`` holds the registered
queries and their SQL.
"""
