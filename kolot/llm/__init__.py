"""Operators for preparing training data, one module each.

Nothing else in the library imports this subpackage; `kolot.llm.queries` registers its
queries and their SQL.
"""
