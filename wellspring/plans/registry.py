"""Name -> (query, oracle SQL) registry used by ``__spark_entry__``."""

from __future__ import annotations

import importlib
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_MODULES = [
    "wellspring.plans.registered_corpus",
    "wellspring.plans.registered_checkin",
    "wellspring.plans.registered_topics",
    "wellspring.plans.registered_stream",
    "wellspring.plans.registered_debrief",
    "wellspring.plans.registered_reviews",
    "wellspring.plans.registered_ml",
]


def _collect():
    queries: dict[str, QueryFn] = {}
    oracles: dict[str, str] = {}
    for mod_name in _MODULES:
        mod = importlib.import_module(mod_name)
        for attr in dir(mod):
            if attr.startswith("q_"):
                name = attr[2:]
                queries[name] = getattr(mod, attr)
                oracle = getattr(mod, f"oracle_{name}", None)
                if oracle is not None:
                    oracles[name] = oracle()
    return queries, oracles


def queries() -> dict[str, QueryFn]:
    return _collect()[0]


def oracle_sql() -> dict[str, str]:
    return _collect()[1]
