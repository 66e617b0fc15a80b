"""Operators for preparing training data, and the queries that apply them to whole tables.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

from importlib import import_module

#: Modules with ``QUERIES``, and ``ORACLES`` where SQL can express a query.
MODULES = ("dedup", "sharding", "vectors", "langid", "mixing", "toxicity", "licenses", "ann", "warc", "bpe")


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict:
    found = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), "ORACLES", {})
    return found
