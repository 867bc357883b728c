"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; :mod:`graphloom.llm.registry` holds the thin
contract queries and their SQL.
"""
