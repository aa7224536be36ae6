"""Summaries, keywords and questions of chunks: by rules, or by a callable with the rules to fall back on."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import islice
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import plain, text as t
from docweave.operators.chunking import CHUNK, Numbered, chunk_batches, chunk_from, ranges_label, unique
from docweave.sources import evidence
from docweave.sources.evidence import dumped

Enrich = Callable[[dict], Any]
T = TypeVar("T")
_ASKED = ("의 핵심 내용은 무엇인가요?", "에서 확인해야 할 기준이나 조건은 무엇인가요?")
RESERVE = 256  # tokens of an answer, for each chunk of a batch


def needs(chunk: dict) -> bool:
    return chunk["metadata"].get("_needs_enrichment") is True or not (chunk["summary"] and chunk["keywords"] and chunk["questions"])


def _tables(chunk: dict) -> list[dict]:
    return [i["content"] for i in chunk["evidence"]["items"] if i["type"] == "table" and isinstance(i["content"], dict)]


def _cells(table: dict) -> Iterator[tuple[str, str]]:
    """Column label and text of each cell."""
    label_of = cache(lambda name: plain.flat(own_label(table.get("columns", []), name)))
    for row in table.get("rows", []):
        for c in row.get("cells", []):
            yield label_of(c.get("column_id")), plain.flat(c.get("text", ""))


def own_label(columns: list[dict], name: Any) -> str:
    """A column's text by its id alone, else the id."""
    return next((x for c in columns if c.get("id") == name and (x := str(c.get("text") or "").strip())), str(name or ""))


def title_of(chunk: dict) -> str:
    title = chunk["metadata"].get("title")
    return plain.flat(title) if isinstance(title, str) else ""


def row_label(chunk: dict) -> str:
    ranges = [r for i in chunk["evidence"]["items"] for r in i["metadata"].get("row_ranges") or []]
    return ranges_label(ranges, "행")


def context_of(chunk: dict) -> str:
    for line in chunk["source"]["text"].splitlines():
        if line.strip().startswith("context:"):
            return plain.clipped_clean(plain.flat(line.strip()[8:]), 220)
    captions = [x for table in _tables(chunk) if (x := plain.flat(table.get("caption") or ""))]
    return title_of(chunk) or (plain.clipped_clean(captions[0], 220) if captions else "")


def question_cells(chunk: dict) -> list[str]:
    """Up to five questions that a table of questions and answers asks."""
    is_asked = cache(plain.is_question_label)
    asked = [plain.clean_question(text) for table in _tables(chunk) for label, text in _cells(table) if len(text) >= 4 and is_asked(label)]
    return unique(x for x in asked if x)[:5]


def preview(chunk: dict) -> str:
    """The first four cell texts of two characters or more, then each once."""
    texts = (plain.clipped_clean(text, 80) for table in _tables(chunk) for _, text in _cells(table) if len(text) >= 2)
    return " / ".join(unique(islice(texts, 4)))


def by_rules(chunk: dict) -> dict:
    source, asked = chunk["source"]["text"], question_cells(chunk)
    words = plain.keywords(source, plain.STOPS)
    about, rows = context_of(chunk), row_label(chunk)
    if asked:
        subject = about or title_of(chunk) or "Q&A"
        head = f"{subject}의 {rows} Q&A" if rows else f"{subject} Q&A"
        summary = f"{head}를 다룹니다: {' / '.join(q.rstrip('?') for q in asked[:2])}"
        return {"summary": plain.clipped_clean(summary, 300), "keywords": words, "questions": asked}
    if any(i["type"] == "table" for i in chunk["evidence"]["items"]):
        shown, subject = preview(chunk), about or title_of(chunk)
        if rows:
            summary = f"{subject or '표'}의 {rows} 항목을 다룹니다" + (f": {shown}" if shown else ".")
            asked = [f"{subject or '이 표'}의 {rows} 항목은 무엇인가요?", f"{subject or '이 표'}에서 해당 행의 기준이나 답변은 어떻게 설명되나요?"]
        else:
            summary = f"{subject or '표'} 표 내용을 다룹니다: {shown}" if shown else plain.first_sentence(source)
            asked = [f"{subject or '이 표'} 표에는 어떤 항목이 포함되어 있나요?", f"{subject or '이 표'} 표의 주요 기준이나 값은 무엇인가요?"]
        return {"summary": plain.clipped_clean(summary, 300), "keywords": words, "questions": asked}
    topic = title_of(chunk) or plain.topic(source) or "이 내용"
    return {"summary": plain.first_sentence(source), "keywords": words, "questions": [topic + asks for asks in _ASKED]}


def _with(chunk: dict, found: dict, method: str, warning: str | None = None) -> dict:
    metadata = {k: v for k, v in chunk["metadata"].items() if k != "_needs_enrichment"}
    metadata["_enrichment"] = {"stage": "post_chunking", "method": method}
    if warning is not None:
        metadata["_warnings"] = [*metadata.get("_warnings", []), {"type": "rag_chunk_enrichment_failed", "reason": warning}]
    return {**chunk, **{k: found[k] for k in ("summary", "keywords", "questions")}, "metadata": metadata}


def checked(raw: Any, instead: dict) -> dict:
    """What a callable returned, cleaned and capped; what it lacks comes from the rules."""
    if not isinstance(raw, dict):
        raise ValueError("an enrichment must be an object")
    texts = lambda key: [x for x in raw.get(key) or [] if isinstance(x, str) and x.strip()] if isinstance(raw.get(key), list) else []
    return {
        "summary": plain.flat(raw["summary"] if isinstance(raw.get("summary"), str) else "") or instead["summary"],
        "keywords": unique(map(plain.flat, texts("keywords")))[:8] or instead["keywords"],
        "questions": unique(map(plain.clean_question, texts("questions")))[:5] or instead["questions"],
    }


def enriched(chunk: dict, enrich: Enrich | None = None, method: str = "custom") -> dict:
    if enrich is None:
        return _with(chunk, by_rules(chunk), "heuristic") if needs(chunk) else chunk
    try:
        return _with(chunk, checked(enrich(chunk), by_rules(chunk)), method)
    except Exception as error:  # a failed call leaves the rules, or what is there
        why = str(error) or type(error).__name__
        return _with(chunk, by_rules(chunk), "heuristic", why) if needs(chunk) else _with(chunk, chunk, "preserved", why)


def payload(chunk: dict) -> dict:
    """What a callable is told of a chunk, capped."""
    shown = []
    for i in chunk["evidence"]["items"]:
        record: dict = {"type": i["type"], "format": i["format"], "source_unit_ids": i["source_unit_ids"]}
        if i["type"] == "table" and isinstance(i["content"], dict):
            columns = i["content"].get("columns", [])
            rows = [{"index": r.get("index"), "cells": [{"column": own_label(columns, c.get("column_id")), "text": plain.clipped_clean(x, 500)} for c in r.get("cells", []) if (x := plain.flat(c.get("text", "")))]} for r in i["content"].get("rows", [])[:60]]
            record["table"] = {"caption": i["content"].get("caption") or "", "columns": [x for c in columns if (x := str(c.get("text", "")).strip())][:80], "row_ranges": i["metadata"].get("row_ranges") or [], "rows": rows}
        elif isinstance(i["content"], str):
            record["text"] = plain.clipped_clean(i["content"], 2000)
        else:
            record["content_preview"] = plain.clipped_clean(json.dumps(i["content"], ensure_ascii=False), 2000)
        shown.append(record)
    m = chunk["metadata"]
    return {"id": chunk["id"], "source_unit_ids": m["source_unit_ids"], "context_unit_ids": m.get("context_unit_ids", []), "title": m["title"] if isinstance(m.get("title"), str) else "", "source_text": plain.clipped_clean(chunk["source"]["text"], 12000), "evidence": shown}


def batch_cost(chunk: dict) -> int:
    return plain.tokens(dumped(payload(chunk))) + RESERVE


def grouped(chunks: Iterable[T], budget: int, chunk: Callable[[T], dict] = lambda c: c) -> Iterator[list[T]]:
    """Greedy, in order; a chunk above the budget is a batch by itself.  No more than a batch is held."""
    out: list[T] = []
    held = 0
    for c in chunks:
        cost = max(1, batch_cost(chunk(c)))
        if out and held + cost > budget:
            yield out
            out, held = [], 0
        out.append(c)
        held += cost
    if out:
        yield out


def batches_of(chunks: list[dict], budget: int) -> list[list[dict]]:
    return list(grouped(chunks, budget))


def enriched_batch(chunks: list[dict], ask: Callable[[list[dict]], Any], one: Enrich) -> list[dict]:
    """One call for several chunks; chunk by chunk if it fails or leaves one out."""
    try:
        raw = ask(chunks)
        found = {x["id"]: x for x in raw["chunks"] if isinstance(x, dict) and "id" in x}
        return [_with(c, checked(found[c["id"]], by_rules(c)), "llm_batch") for c in chunks]
    except Exception:  # each chunk says by itself what went wrong
        return [enriched(c, one, "llm") for c in chunks]


def filled(chunks: Iterator[Numbered], call: Enrich | None = None, batch: Callable[[list[dict]], Any] | None = None, budget: int = 24_000) -> Iterator[Numbered]:
    """The chunks with their fields filled in; with batch, as many as the budget allows are asked about together."""
    if batch is None:
        for doc_id, n, c in chunks:
            yield doc_id, n, enriched(c, call)
        return
    named = ((doc_id, n, {**c, "id": f"{doc_id}/{c['id']}"}) for doc_id, n, c in chunks)
    for group in grouped(named, budget, lambda x: x[2]):
        for (doc_id, n, c), d in zip(group, enriched_batch([c for _, _, c in group], batch, call or by_rules)):
            yield doc_id, n, {**d, "id": c["id"].partition("/")[2]}


def enrich(chunks: DataFrame, call: Enrich | None = None, batch: Callable[[list[dict]], Any] | None = None, budget: int = 24_000) -> DataFrame:
    """chunks with their fields filled in; with batch, the chunks of a task are asked about together, within the budget."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chunk_batches(filled(((r["doc_id"], r["ord"], chunk_from(r)) for r in evidence.rows_in(batches)), call, batch, budget))

    return chunks.mapInArrow(apply, CHUNK)


def text_rules(source: Column, title: Column | None = None) -> dict[str, Column]:
    """The rules for chunks of text, as columns."""
    topic = F.coalesce(F.nullif(t.normalize_space(title), F.lit("")) if title is not None else F.lit(None), F.nullif(t.topic(source), F.lit("")), F.lit("이 내용"))
    return {"summary": t.first_sentence(source), "keywords": t.keywords_without_stops(source), "questions": F.array(*(F.concat(topic, F.lit(asks)) for asks in _ASKED))}


__all__ = ["batches_of", "by_rules", "checked", "enrich", "enriched", "enriched_batch", "filled", "needs", "payload", "text_rules"]
