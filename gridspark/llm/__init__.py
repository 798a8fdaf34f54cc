"""Operators for large text corpora and their queries.

Nothing else in the library imports this package. `queries()` and `oracle_sql()` list what the entry point registers.
"""

from __future__ import annotations


def queries():
    from .catalog import QUERIES
    return dict(QUERIES)


def oracle_sql():
    from .catalog import ORACLES
    return dict(ORACLES)
