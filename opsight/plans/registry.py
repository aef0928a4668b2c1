"""Registry of named queries: key -> Spark callable (spark, sf_dir) and key -> DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def query(key: str, oracle: str | None = None, headline: bool = False):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        if headline:
            HEADLINE.append(key)
        return fn
    return deco


def model_query(key: str, oracle: str | None = None, headline: bool = False):
    """`query` for a function of a Model, which stays callable with any Model (a cycle's, an earlier time's)."""
    def deco(fn):
        def run(spark, sf_dir):
            from ..sources.adapters import Model
            return fn(Model(spark, sf_dir))

        query(key, oracle, headline)(run)
        return fn
    return deco


def load_all():
    """Import every plan module so their queries register."""
    from . import (  # noqa: F401
        anomaly_plans,
        cycle_plans,
        enterprise_plans,
        health_plans,
        leading_plans,
        predictor_plans,
        signal_plans,
        source_plans,
        stream_plans,
    )
    return QUERIES, ORACLES
