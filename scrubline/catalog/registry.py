"""All registered queries."""

from __future__ import annotations

from scrubline.catalog import cleaning, featuring, profiling, running

MODULES = (cleaning, profiling, featuring, running)


def queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
