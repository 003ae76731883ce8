"""Collects the registered plans of every theme module."""

from __future__ import annotations

import importlib

MODULES = [
    "tierline.plans.core",
    "tierline.plans.inference",
    "tierline.plans.landing",
    "tierline.plans.governance",
    "tierline.plans.reports",
    "tierline.plans.lineage",
    "tierline.plans.recall",
    "tierline.plans.charts",
    "tierline.plans.catalog",
    "tierline.plans.streaming",
    "tierline.plans.storage",
]


def _entries():
    out = {}
    for m in MODULES:
        mod = importlib.import_module(m)
        for name, (fn, sql) in mod.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = (fn, sql)
    return out


def _utc(fn):
    """Driver timestamps are zone-less (NTZ) and compared with a UTC oracle;
    pin the session zone so casts to TIMESTAMP and day windows agree."""
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def all_queries():
    return {k: _utc(fn) for k, (fn, _) in _entries().items()}


def all_oracle_sql():
    return {k: sql for k, (_, sql) in _entries().items() if sql is not None}
