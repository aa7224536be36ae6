"""Inspection pages: a document's units or chunks as HTML."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from html import escape
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.operators import diagrams
from docweave.operators.chunking import chunk_from
from docweave.sources import evidence
from docweave.sources.spread import by_document

_STYLE = "body{font-family:sans-serif;margin:2rem auto;max-width:70rem}section{border:1px solid #ccc;margin:1rem 0;padding:1rem}table{border-collapse:collapse}td,th{border:1px solid #999;padding:.2rem .5rem}.canvas{position:relative}.canvas>div{position:absolute;border:1px solid #555;overflow:hidden}pre{white-space:pre-wrap}"
_PLACED = frozenset(["", *"box container ellipse group label polygon rect rectangle shape textbox".split()])
_SHOWN_METADATA = frozenset("source_unit_ids source_units context_unit_ids operations title common _boundary_merges _fallback_reason _warnings _rejected_plan _needs_enrichment".split())


def _tag(name: str, inner: str, **attrs: Any) -> str:
    listed = "".join(f' {k.rstrip("_").replace("_", "-")}="{escape(str(v))}"' for k, v in attrs.items() if v is not None)
    return f"<{name}{listed}>{inner}</{name}>"


def _lines(text: Any) -> str:
    return "<br>".join(map(escape, str(text).split("\n")))


def clipped_rows(rows: list[dict], columns: int) -> list[list[tuple[dict | None, int, int, int]]]:
    """By row its cells as (cell, column, rowspan, colspan): spans cut where another cell begins, gaps as None."""
    place = lambda c, at: int(c["column_id"][1:]) - 1 if str(c.get("column_id", "")).startswith("c") and c["column_id"][1:].isdigit() else at
    starts = []
    for row in rows:
        at, own = 0, []
        for c in row.get("cells", []):
            at = place(c, at)
            own.append((at, c))
            at += c.get("colspan", 1)
        starts.append(own)
    taken: dict[int, int] = {}  # by column: the first row that is free again
    out = []
    for i, own in enumerate(starts):
        line: list[tuple[dict | None, int, int, int]] = []
        at = 0

        def fill(upto: int) -> None:
            nonlocal at
            while at < upto:
                if taken.get(at, 0) <= i:
                    line.append((None, at, 1, 1))
                at += 1

        for column, c in own:
            fill(column)
            wide, tall = max(1, c.get("colspan", 1)), max(1, min(c.get("rowspan", 1), len(rows) - i))
            for k in range(1, tall):
                if any(column <= other < column + wide for other, _ in starts[i + k]):
                    tall = k
                    break
            line.append((c, column, tall, wide))
            taken.update({column + j: i + tall for j in range(wide)})
            at = max(at, column + wide)
        fill(columns)
        out.append(line)
    return out


def _in_place(row: dict, columns: int) -> bool:
    """Whether a row has one plain cell for each of so many columns, in order."""
    cells = row.get("cells", [])
    return len(cells) == columns > 0 and all(c["column_id"] == f"c{i}" and type(c["text"]) is str and c.get("colspan", 1) == 1 == c.get("rowspan", 1) and not c.get("children") for i, c in enumerate(cells, 1))


def table(content: dict, assets: dict[str, dict]) -> str:
    columns, rows = content.get("columns", []), content.get("rows", [])
    if not columns and not rows:
        return _tag("p", "빈 표", class_="empty-table")

    n = len(columns)

    def lines(some: list[dict], name: str) -> str:
        out = []
        if all(_in_place(r, n) for r in some):
            for r in some:
                inner = [t if (t := c["text"]).isalnum() else _lines(t) or "&nbsp;" for c in r["cells"]]
                out.append(f"<tr><{name}>" + f"</{name}><{name}>".join(inner) + f"</{name}></tr>")
            return "".join(out)
        for line in clipped_rows(some, len(columns)):
            cells = []
            for c, _, tall, wide in line:
                inner = _lines(c["text"]) + "".join(item(x, assets) for x in c.get("children", [])) if c else ""
                cells.append(_tag(name, inner or "&nbsp;", rowspan=tall if tall > 1 else None, colspan=wide if wide > 1 else None))
            out.append(_tag("tr", "".join(cells)))
        return "".join(out)

    heads = [r for r in content.get("header_rows", []) if any(str(c.get("text", "")).strip() or c.get("children") for c in r.get("cells", []))]
    top = lines(heads, "th") if heads else _tag("tr", "".join(_tag("th", escape(str(c.get("text", ""))) or "&nbsp;") for c in columns)) if columns else ""
    body = lines(rows, "td") if rows else _tag("tr", _tag("td", "&nbsp;", colspan=len(columns)))
    caption = _tag("caption", escape(content["caption"])) if content.get("caption") else ""
    return _tag("table", caption + (_tag("thead", top) if top else "") + _tag("tbody", body), class_="evidence-table")


def outline(texts: list[str]) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """Titles before the first section, and sections with their texts; a section's name stands in angle brackets."""
    title: list[str] = []
    sections: list[tuple[str, list[str]]] = []
    for t in texts:
        if t[:1] == "<" and t[-1:] == ">":
            sections.append((t, []))
        else:
            (sections[-1][1] if sections else title).append(t)
    return ([], [("", title)]) if title and not sections else (title, sections)


def routes(texts: list[str]) -> list[tuple[str, list[str], list[str]]]:
    """A section's texts as ("note", [text], []) and ("route", steps, actors): steps lead to the actors after them."""
    out: list[tuple[str, list[str], list[str]]] = []
    steps: list[str] = []
    actors: list[str] = []

    def flush() -> None:
        if steps or actors:
            out.append(("route", list(steps), list(actors)))
        steps.clear()
        actors.clear()

    for t in filter(None, (x.strip() for x in texts)):
        if (t[0], t[-1]) in (("(", ")"), ("[", "]")):
            flush()
            out.append(("note", [t], []))
        elif diagrams.STEP.match(t):
            if actors:
                flush()
            steps += diagrams.split_steps(t)
        elif steps and not actors and len(t) > 20:
            steps[-1] += f"\n{t}"
        else:
            actors.append(t)
    flush()
    return out


def placed(nodes: list[dict], connectors: list[dict]) -> list[tuple[str, float, float, float, float]]:
    """Texts with left, top, width and height in per cent of the whole drawing."""
    boxes = [(n, b) for n in nodes if (b := diagrams.box(n))]
    points = [p for c in connectors for p in (c.get("points") or [])[:2]]
    xs = [v for _, b in boxes for v in (b[0], b[0] + b[2])] + [p["x"] for p in points]
    ys = [v for _, b in boxes for v in (b[1], b[1] + b[3])] + [p["y"] for p in points]
    if not xs:
        return []
    w, h = max(max(xs) - min(xs), 1.0), max(max(ys) - min(ys), 1.0)
    return [(str(n.get("text", "")), 100 * (b[0] - min(xs)) / w, 100 * (b[1] - min(ys)) / h, 100 * b[2] / w, 100 * b[3] / h) for n, b in boxes]


def layout_of(content: dict) -> str:
    """Which way a diagram is shown: outline, placed, labels or list."""
    nodes, edges = content.get("nodes", []), content.get("edges", [])
    texts = [t for n in nodes if (t := str(n.get("text", "")).strip())]
    if str(content.get("mermaid") or "").strip() or not nodes:
        return "list"
    if any("흐름도" in t for t in texts[:3]) and any(t[0] == "<" and t[-1] == ">" for t in texts) and any(map(diagrams.STEP.match, texts)):
        return "outline"
    shapes = {str(n.get("shape_type", "label")).strip() for n in nodes}
    lines = any(len(c.get("points") or []) >= 2 for c in content.get("connectors", []))
    if shapes <= _PLACED and (sum(diagrams.box(n) is not None for n in nodes) >= 2 or lines):
        return "placed"
    return "labels" if not edges and shapes <= {"", "label"} else "list"


def diagram(content: dict) -> str:
    nodes, edges = content.get("nodes", []), content.get("edges", [])
    how = layout_of(content)
    if how in ("outline", "labels"):
        title, sections = outline([t for n in nodes if (t := str(n.get("text", "")).strip())])
        parts = [_tag("h3", _lines(t)) for t in title]
        for name, texts in sections:
            groups = "".join(_tag("div", " → ".join(_lines(x) for x in [*a, *b]), class_=kind) for kind, a, b in routes(texts))
            parts.append(_tag("section", (_tag("h4", escape(name)) if name else "") + groups))
        return _tag("section", "".join(parts), class_="diagram-flowchart")
    if how == "placed":
        at = "".join(_tag("div", _lines(t), style=f"left:{x:.2f}%;top:{y:.2f}%;width:{w:.2f}%;height:{h:.2f}%") for t, x, y, w, h in placed(nodes, content.get("connectors", [])))
        loose = "".join(_tag("span", _lines(t)) for n in nodes if not diagrams.box(n) and (t := str(n.get("text", "")).strip()))
        return _tag("section", loose + _tag("div", at, class_="canvas", style="height:24rem"), class_="diagram-positioned")
    items = "".join(_tag("li", f"{_tag('code', escape(n['id']))} {escape(str(n.get('text', ''))) or '&nbsp;'}") for n in nodes)
    ties = "".join(_tag("li", f"{_tag('code', escape(e['from'] + ' → ' + e['to']))} {escape(' · '.join(x for x in (str(e.get('label', '')).strip(), str(e.get('confidence', '')).strip()) if x))}") for e in edges)
    drawn = str(content.get("mermaid") or "").strip()
    inner = (_tag("ol", items) if items else "") + (_tag("ul", ties) if ties else "") + (_tag("pre", escape(drawn), class_="mermaid") if drawn else "")
    return _tag("section", inner or _tag("p", "빈 다이어그램"), class_="diagram-evidence")


def asset(kind: str, content: dict, assets: dict[str, dict]) -> str:
    known = assets.get(content.get("asset_id"), {})
    pick = lambda *names: next((v for n in names for v in (content.get(n), known.get(n)) if v is not None and v != ""), None)
    where, name = pick("public_url", "preview_url", "uri"), str(content.get("caption") or content.get("asset_id") or "asset")
    size = pick("bytes")
    facts = " · ".join(str(x) for x in (pick("mime"), f"{size} bytes" if size is not None else None, pick("sha256")) if x)
    link = _tag("a", escape(where), href=where) if where else ""
    note = _tag("p", escape(facts), class_="asset-meta")
    if kind != "image":
        return _tag("div", _tag("strong", escape(name)) + link + note, class_="asset-ref")
    image = f'<img src="{escape(where)}" alt="{escape(name)}">' if where else ""
    return _tag("figure", image + _tag("figcaption", escape(name)) + link + note)


def item(x: dict, assets: dict[str, dict]) -> str:
    kind, form, content = x.get("type", x.get("kind", "text")), x.get("format"), x.get("content")
    if form == "structured_table":
        return table(content, assets)
    if form == "structured_diagram":
        return diagram(content)
    if form == "asset_ref":
        return asset(kind, content, assets)
    return _tag("p", _lines(content)) if isinstance(content, str) else _tag("pre", escape(str(content)))


def _page(title: str, parts: list[str]) -> str:
    head = f'<meta charset="utf-8">{_tag("title", escape(title))}{_tag("style", _STYLE)}'
    return f'<!doctype html>\n{_tag("html", _tag("head", head) + _tag("body", _tag("main", _tag("h1", escape(title)) + "".join(parts))), lang="ko")}'


def units_page(units: list[dict], assets: dict[str, dict] | None = None, title: str = "Evidence units") -> str:
    return _page(title, [_tag("section", _tag("header", f"{_tag('code', escape(u['id']))} {escape(u['type'])}") + _tag("pre", escape(u["source"]["text"])) + item(u, assets or {}), class_="unit") for u in units])


def _details(name: str, value: Any) -> str:
    return _tag("details", _tag("summary", name) + _tag("pre", escape(json.dumps(value, ensure_ascii=False, indent=1)))) if value else ""


def chunk_section(c: dict, assets: dict[str, dict]) -> str:
    m = c["metadata"]
    listed = lambda xs: _tag("ul", "".join(_tag("li", escape(x)) for x in xs)) if xs else ""
    facts = [f"source units: {', '.join(m['source_unit_ids'])}", *([f"context units: {', '.join(m['context_unit_ids'])}"] if m.get("context_unit_ids") else []), f"evidence items: {len(c['evidence']['items'])}", *([f"unit types: {', '.join(m['common']['unit_types'])}"] if m.get("common", {}).get("unit_types") else [])]
    diagnostics = _tag("p", f"fallback: {escape(m['_fallback_reason'])}", class_="diagnostic") if m.get("_fallback_reason") else ""
    rest = {k: v for k, v in m.items() if k not in _SHOWN_METADATA}
    parts = [_tag("header", _tag("code", escape(c["id"]))), _tag("h2", escape(m["title"])) if m.get("title") else "", _tag("p", escape(c["summary"]), class_="summary"), listed(c["keywords"]), listed(c["questions"]), listed(facts), listed([f"{u['id']} {u['type']} / {u['format']}" for u in m.get("source_units", [])])]
    parts += [_details("operations", m.get("operations")), _details("boundary merges", m.get("_boundary_merges")), _details("other metadata", rest), diagnostics, _details("warnings", m.get("_warnings")), _details("rejected plan", m.get("_rejected_plan")), _tag("pre", escape(c["source"]["text"]))]
    parts += [_tag("div", item(i, assets), class_="evidence-item") for i in c["evidence"]["items"]]
    return _tag("section", "".join(parts), class_="chunk")


def chunks_page(chunks: list[dict], assets: dict[str, dict] | None = None, title: str = "RAG chunks") -> str:
    return _page(title, [chunk_section(c, assets or {}) for c in chunks])


def page_batches(documents: Iterator[tuple[int, list[dict]]], page: Callable[[list[dict]], str], name: str = "html") -> Iterator[pa.RecordBatch]:
    """doc_id and the page of each document."""
    schema = pa.schema([("doc_id", pa.int64()), (name, pa.string())])
    return evidence.in_batches(({"doc_id": doc_id, name: page(held)} for doc_id, held in documents), schema)


def _pages(rows: DataFrame, read: Callable[[dict], dict], page: Callable[[list[dict]], str], together: bool) -> DataFrame:
    """doc_id, html; a task holds one document at a time.  together: rows of a document lie one after the other, so nothing is shuffled."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return page_batches(((doc_id, [read(r) for r in own]) for doc_id, own in groupby(evidence.rows_in(batches), lambda r: r["doc_id"])), page)

    return (rows if together else by_document(rows, "ord")).mapInArrow(apply, "doc_id long, html string")


def unit_pages(units: DataFrame, together: bool = False) -> DataFrame:
    return _pages(units, evidence.unit_of, units_page, together)


def chunk_pages(chunks: DataFrame, together: bool = False) -> DataFrame:
    return _pages(chunks, chunk_from, chunks_page, together)


def _bare(value: Any) -> Any:
    if isinstance(value, dict):
        skip = {k for k in ("header_rows", "compact", "asset_id", "confidence") if k in value and not value[k]}
        if "format" in value and value.get("metadata") == {}:
            skip.add("metadata")
        return {k: _bare(v) for k, v in value.items() if k not in skip}
    return [_bare(x) for x in value] if isinstance(value, list) else value


def units_json(units: list[dict]) -> str:
    """Units as one JSON array; null and empty optional fields of tables and diagrams left out."""
    return f"[{','.join(map(_unit_json, units))}]"


def _unit_json(unit: dict) -> str:
    told = unit if isinstance(unit["content"], evidence.Written) else _bare(unit)  # what is written has no such fields
    return "{" + ",".join(f"{evidence.dumped(k)}:{evidence.dumped(v)}" for k, v in told.items()) + "}"


def evidence_json(units: DataFrame, together: bool = False) -> DataFrame:
    """doc_id, json: a document's units as units_json has them."""
    return _pages(units, evidence.unit_of, units_json, together).withColumnRenamed("html", "json")
