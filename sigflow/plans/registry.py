"""All registered queries (Spark callables) and their DuckDB oracles."""

from __future__ import annotations

import importlib

# Query modules, each exporting QUERIES (name -> fn(spark, sf_dir)) and
# ORACLES (name -> DuckDB SQL; absent for property-checked operators).
MODULES = [
    "sigflow.plans.q_neighbors",
    "sigflow.plans.q_tables",
    "sigflow.plans.q_aggregates",
    "sigflow.plans.q_correlations",
    "sigflow.plans.q_enrich",
    "sigflow.plans.q_compounds",
    "sigflow.plans.q_ml",
    "sigflow.plans.q_reduce",
    "sigflow.plans.q_io",
]


def _load():
    queries, oracles = {}, {}
    for m in MODULES:
        mod = importlib.import_module(m)
        for k, v in mod.QUERIES.items():
            if k in queries:
                raise ValueError(f"duplicate query {k}")
            queries[k] = v
        oracles.update(getattr(mod, "ORACLES", {}))
    return queries, oracles


def queries():
    return _load()[0]


def oracle_sql():
    q, o = _load()
    return {k: v for k, v in o.items() if k in q}
