"""All registered queries: ``name -> callable(spark, sf_dir)`` and oracle SQL."""

from __future__ import annotations

import importlib

PLAN_MODULES = (
    "corpusgraph.plans.graph_queries",
    "corpusgraph.plans.tabular_queries",
    "corpusgraph.plans.text_queries",
    "corpusgraph.plans.entity_queries",
    "corpusgraph.plans.community_queries",
    "corpusgraph.plans.stream_queries",
    "corpusgraph.plans.answer_queries",
    "corpusgraph.plans.code_queries",
)


def _registries():
    return [importlib.import_module(m).reg for m in PLAN_MODULES]


def all_queries() -> dict:
    out: dict = {}
    for r in _registries():
        for k, v in r.queries.items():
            if k in out:
                raise ValueError(f"duplicate query {k}")
            out[k] = v
    return out


def all_sql() -> dict:
    out: dict = {}
    for r in _registries():
        out.update(r.sql)
    return out
