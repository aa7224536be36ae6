"""All queries over the tables by name, and the SQL they are checked by."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("text_queries", "corpus_queries", "parse_queries", "chunk_queries", "geometry_queries", "render_queries", "repair_queries")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = import_module(f"docweave.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
