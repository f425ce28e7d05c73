"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``queries`` registers the thin queries.
"""
