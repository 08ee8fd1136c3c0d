"""Operators for preparing training text: one module an operator.

Nothing outside this folder imports it. ``entry.queries()`` lists its queries
and ``entry.oracle_sql()`` their SQL, for those that SQL can express.
"""
