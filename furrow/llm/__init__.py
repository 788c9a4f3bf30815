"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()``
in :mod:`furrow.llm.queries` are what the entry module registers.
"""
