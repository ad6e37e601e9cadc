"""Operators for preparing training data: one module per operator.

Nothing else in the library imports this subpackage.  ``registry.py`` lists
the queries and their SQL.
"""
