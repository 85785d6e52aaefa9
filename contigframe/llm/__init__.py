"""Operators for preparing training text, their registered queries and SQL.

Nothing else in the library imports this subpackage.
"""
