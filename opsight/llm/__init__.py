"""Training-data operators: sharding, near-duplicates, tokenising, archives, search, mixing, filters.

Nothing outside this subpackage imports it; the driver's entry file adds what `register` returns.
"""

from __future__ import annotations


def register() -> tuple[dict, dict]:
    """(queries, oracle SQL) of the subpackage."""
    from . import queries as q

    return dict(q.QUERIES), dict(q.ORACLES)
