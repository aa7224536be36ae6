"""Reading with what follows it for each document, in one Python pass.

The same steps as plans of their own (``evidence.read``, ``chunking.chunks``,
``enrichment.enrich``, ``rendering``) each take a worker per task, and hand
their trees on as JSON.  Where nothing else reads what lies between, a worker
takes a document through all of them as objects, one at a time.  Each row of
docs (doc_id, suffix, content) is a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.operators import chunking, rendering
from docweave.operators.chunking import Numbered
from docweave.sources import evidence
from docweave.sources.evidence import Reader

Fill = Callable[[Iterator[Numbered]], Iterator[Numbered]]


def _units(batches: Iterator[pa.RecordBatch], readers: Mapping[str, Reader]) -> Iterator[tuple[int, list[dict]]]:
    return ((doc_id, found.units) for doc_id, found in evidence.parsed(readers)(batches) if found.units)


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "suffix", "content")


def chunks(docs: DataFrame, readers: Mapping[str, Reader], limits: chunking.Limits = chunking.Limits(), plan: chunking.Plan | None = None, decide: chunking.Merge | None = None, fill: Fill | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """The documents' chunks, all columns of them or some; fill (as ``enrichment.filled``) is applied to a task's chunks."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = chunking.chunked(_units(batches, readers), limits, plan, decide)
        return chunking.chunk_batches(fill(made) if fill else made, columns)

    return _docs(docs).mapInArrow(apply, chunking.chunk_columns(columns))


def chunk_pages(docs: DataFrame, readers: Mapping[str, Reader], limits: chunking.Limits = chunking.Limits(), enrich: Callable[[dict], dict] = lambda c: c) -> DataFrame:
    """doc_id, html: the documents' chunks, each as enrich returns it."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rendering.page_batches(((doc_id, [enrich(c) for c in chunking.chunk_document(units, limits)]) for doc_id, units in _units(batches, readers)), rendering.chunks_page)

    return _docs(docs).mapInArrow(apply, "doc_id long, html string")


def unit_pages(docs: DataFrame, readers: Mapping[str, Reader]) -> DataFrame:
    """doc_id, html: the documents' units."""
    return _docs(docs).mapInArrow(lambda batches: rendering.page_batches(_units(batches, readers), rendering.units_page), "doc_id long, html string")


def evidence_json(docs: DataFrame, readers: Mapping[str, Reader]) -> DataFrame:
    """doc_id, json: the documents' units as ``rendering.units_json`` has them."""
    return _docs(docs).mapInArrow(lambda batches: rendering.page_batches(_units(batches, readers), rendering.units_json, "json"), "doc_id long, json string")
