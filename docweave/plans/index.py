"""From documents to what a search index takes, in one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import assets, chunking, enrichment, rendering
from docweave.sources import evidence
from docweave.sources.evidence import Reader
from docweave.sources.registry import default_readers


@dataclass
class Indexed:
    evidence: DataFrame
    units: DataFrame
    assets: DataFrame | None
    warnings: DataFrame
    chunks: DataFrame

    def pages(self) -> DataFrame:
        return rendering.chunk_pages(self.chunks, together=True)


def _as_it_is(df: DataFrame) -> DataFrame:
    return df


def index(
    docs: DataFrame,
    readers: Mapping[str, Reader] | None = None,
    put: assets.Put | None = None,
    limits: chunking.Limits = chunking.Limits(),
    plan: chunking.Plan | None = None,
    decide: chunking.Merge | None = None,
    enrich: enrichment.Enrich | None = None,
    keep: Callable[[DataFrame], DataFrame] = _as_it_is,
) -> Indexed:
    """Reads docs (doc_id, suffix, content), puts their assets where put says, chunks and enriches their units.

    keep is applied to the evidence, which several plans read; give it
    something that stores what it gets (a written table) for large inputs.
    """
    found = keep(evidence.read(docs, {**default_readers(), **(readers or {})}))
    units, stored = evidence.units(found), None
    if put is not None:
        hashes = docs.select("doc_id", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
        stored = keep(assets.stored(evidence.assets(found), hashes, put))
        units = assets.resolved(units, stored)
    made = enrichment.enrich(chunking.chunks(units, limits, plan, decide, together=put is None and keep is _as_it_is), enrich)
    return Indexed(found, units, stored, evidence.warnings(found), made)


def summary(results: DataFrame) -> dict[str, Any]:
    """A corpus summary (measure, total) as a dictionary; it has a row per measure."""
    return {r[0]: r[1] for r in results.collect()}
