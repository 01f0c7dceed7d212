"""Operators for preparing training text: one module per operator.

Nothing outside this subpackage imports it; ``queries.py`` registers the
operators' queries and their SQL.
"""
