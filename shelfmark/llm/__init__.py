"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it. Every module holds one operator with a
general interface; :mod:`shelfmark.llm.queries` derives the registered queries.
"""
