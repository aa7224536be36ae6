"""Page layouts: what a PDF's pages hold, as JSON.

``{"pages": [{"width", "height", "chars": [{"text", "x0", "top", "x1",
"bottom"}], "images", "rects", "lines", "curves", "tables": [{"bbox", "rows":
[{"cells": [box or null], "texts": [text or null]}]}]}]}``.  An image may
carry its bytes in base64, and so may a page its ``picture`` as PNG, which is
what a reader of pictures is given.  Reading PDF bytes themselves needs a library that
yields these; ``parse_with`` takes one.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable

from docweave.operators import diagrams, layout, page_tables, page_texts
from docweave.sources.evidence import Parsed
from docweave.sources.hwpx import mime_of

TABLE_WORDS = frozenset("연번 질의 답변 현행 개정 비고 항목 제목 세부인정사항 구분 EDI코드 코드 부위 분류 번호 행위명 수가 본인부담률".split())
Ocr = Callable[[bytes, int], str]


def box(shape: dict) -> layout.Box:
    x0, y0 = float(shape.get("x0", 0)), float(shape.get("top", shape.get("y0", 0)))
    x1, y1 = float(shape.get("x1", x0)), float(shape.get("bottom", shape.get("y1", y0)))
    return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)


def crop(page: dict, b: layout.Box) -> str:
    """The text in a box, in lines from top to bottom."""
    if b[3] - b[1] <= 2 or b[2] - b[0] <= 2:
        return ""
    rows: list[list[dict]] = []
    for c in sorted(page.get("chars", []), key=lambda c: (c["top"], c["x0"])):
        x, y = (c["x0"] + c["x1"]) / 2, (c["top"] + c["bottom"]) / 2
        if b[0] <= x < b[2] and b[1] <= y < b[3]:
            if rows and c["top"] - rows[-1][0]["top"] <= 3:
                rows[-1].append(c)
            else:
                rows.append([c])
    lines = []
    for row in rows:
        row.sort(key=lambda c: c["x0"])
        lines.append("".join((" " if i and c["x0"] - row[i - 1]["x1"] > 3 else "") + c["text"] for i, c in enumerate(row)))
    return page_texts.clean("\n".join(lines))


def image_share(page: dict, image: dict) -> tuple[float, float]:
    x0, top, x1, bottom = box(image)
    return (x1 - x0) / (page.get("width") or 1), (bottom - top) / (page.get("height") or 1)


def ocr_reason(page: dict, degraded_counts: bool) -> str | None:
    """Why a page should be read as a picture: hardly any text below a large image, or text that is mostly marks."""
    text = "".join(c["text"] for c in page.get("chars", []) if c["text"].strip())
    if len(text) < 30 and any(min(image_share(page, i)) > 0.7 for i in page.get("images", [])):
        return "scanned"
    n = len(text)
    if degraded_counts and page.get("images") and 15 <= n <= 250:
        cjk, latin, marks = sum(bool(page_tables.CJK.match(c)) for c in text), sum(c.isascii() and c.isalpha() for c in text), sum(not c.isalnum() for c in text)
        if cjk < 0.05 * n and latin < 0.1 * n and marks >= 0.45 * n:
            return "degraded_native_text"
    return None


class _Page:
    def __init__(self, reader: _Reader, number: int, page: dict):
        self.reader, self.number, self.page = reader, number, page
        self.tables = [(box_of(t), t) for t in page.get("tables", [])]
        self.cell_children: dict[tuple[int, int, int], list[dict]] = {}
        self.parents = self.nesting()

    def nesting(self) -> dict[int, tuple[int, int, int]]:
        """By table: the smallest cell of a larger table that it lies in."""
        out = {}
        for i, (b, _) in enumerate(self.tables):
            cells = [c for c in self.cells() if c[0][0] != i and not layout.alike(self.tables[c[0][0]][0], b) and layout.area(self.tables[c[0][0]][0]) > layout.area(b)]
            found = layout.smallest_around(b, cells, 2.0)
            if found:
                out[i] = found
        return out

    def cells(self) -> list[tuple[tuple[int, int, int], layout.Box]]:
        return [((i, r, c), tuple(x)) for i, (_, t) in enumerate(self.tables) for r, row in enumerate(t["rows"]) for c, x in enumerate(row["cells"]) if x]

    def table(self, i: int) -> dict | None:
        raw = self.tables[i][1]["rows"]
        texts = page_tables.trimmed([[page_tables.cell_text(x) for x in row.get("texts", [])] for row in raw])
        n = max(map(len, texts), default=0)
        if not n:
            return None
        texts = [r + [""] * (n - len(r)) for r in texts]
        depth = page_tables.header_depth(texts)
        columns = page_tables.columns(texts[:depth], n)
        boxes = [[tuple(x) if x else None for x in row["cells"]] for row in raw]
        found, covered = page_tables.spans(boxes, n)

        def cells(r: int) -> list[dict]:
            out = []
            for c in range(n):
                if (r, c) in covered:
                    continue
                tall, wide = found[r, c]
                inner = sorted((k for k, at in self.parents.items() if at == (i, r, c)), key=lambda k: self.tables[k][0][1])
                nested = [{"type": "table", "format": "structured_table", "content": t} for k in inner if (t := self.table(k))]
                text = self.around(boxes[r][c], [self.tables[k][0] for k in inner]) if inner and c < len(boxes[r]) else texts[r][c]
                out.append({"column_id": columns[c]["id"], "text": text, "rowspan": tall, "colspan": wide, "children": [*page_tables.merged_children(nested), *self.cell_children.get((i, r, c), [])]})
            return out

        rows = [x for r in range(depth, len(texts)) if any(map(page_tables.filled, x := cells(r)))]
        heads = [x for r in range(depth) if (x := cells(r))]
        made = {"caption": None, "columns": columns, "rows": [{"index": k, "cells": x} for k, x in enumerate(rows, 1)]}
        if heads:
            made["header_rows"] = [{"index": k, "cells": x} for k, x in enumerate(heads, 1)]
        text = crop(self.page, (0.0, 0.0, self.page["width"], self.page["height"])) if page_tables.is_contents(made) else ""
        return page_tables.repair(made, text)

    def around(self, cell: layout.Box, inner: list[layout.Box]) -> str:
        """A cell's text without that of the tables in it."""
        out, at = [], cell[1]
        for b in [*inner, (0, cell[3], 0, cell[3])]:
            out.append(crop(self.page, (cell[0], at, cell[2], b[1])))
            at = max(at, b[3])
        return " ".join(x for x in out if x)

    def images(self) -> list[tuple]:
        out = []
        for image in sorted(self.page.get("images", []), key=lambda i: box(i)[1]):
            b = box(image)
            if min(image_share(self.page, image)) > 0.8 or layout.area(b) < 2500 or not image.get("data"):
                continue
            data = base64.b64decode(image["data"])
            cell = layout.smallest_around(b, self.cells(), 3.0)
            name = self.reader.parsed.asset(data, *mime_of(data), source="pdf_table_cell_image" if cell else "embedded", bbox=list(b), page=self.number)
            content = {"asset_id": name, "caption": None}
            if cell:
                self.cell_children.setdefault(cell, []).append({"type": "image", "format": "asset_ref", "content": content})
                self.reader.parsed.warn("pdf_table_cell_image_inferred", "low", page=self.number, asset_id=name, message="an image was put into the table cell around it")
            else:
                out.append((b[1], b[3], "image", content, "medium"))
        return out

    def diagram_boxes(self) -> list[layout.Box]:
        """Where boxes and lines lie close together, outside tables, with little text."""
        shapes = []
        for key in ("rects", "lines", "curves"):
            for s in self.page.get(key, []):
                b = box(s)
                w, h = b[2] - b[0], b[3] - b[1]
                if (min(w, h) >= 5 if key == "rects" else max(w, h) >= 10) and not any(layout.crossing(b, t) for t, _ in self.tables):
                    shapes.append((*b, key))
        out = []
        for cluster in layout.vertical_clusters(shapes):
            rects = sum(s[4] == "rects" for s in cluster)
            if rects < 2 or (rects < 3 and rects == len(cluster)):
                continue
            b = (max(0.0, min(s[0] for s in cluster) - 10), max(0.0, min(s[1] for s in cluster) - 10), min(self.page["width"], max(s[2] for s in cluster) + 10), min(self.page["height"], max(s[3] for s in cluster) + 10))
            if not layout.area(b) or len(crop(self.page, b)) <= 0.1 * layout.area(b):
                out.append(b)
        return out

    def diagram(self, around: layout.Box) -> dict:
        placed = lambda b: {"x": round(b[0], 3), "y": round(b[1], 3), "width": round(b[2] - b[0], 3), "height": round(b[3] - b[1], 3), "unit": "pt"}
        rects = [b for s in self.page.get("rects", []) if layout.inside(b := box(s), around) and b[2] - b[0] >= 10 and b[3] - b[1] >= 10]
        texts = [(b, t) for b in sorted(rects, key=lambda b: (b[1], b[0])) if (t := crop(self.page, b))]
        nodes = [{"id": f"n{i}", "shape_type": "rect", "text": t, "bbox": placed(b), "metadata": {"source": "pdf_vector_rect"}} for i, (b, t) in enumerate(texts, 1)]
        connectors = []
        for kind in ("line", "curve"):
            for s in self.page.get(f"{kind}s", []):
                b = box(s)
                if layout.inside(b, around, 3.0) and max(b[2] - b[0], b[3] - b[1]) >= 10:
                    points = [{"x": p[0], "y": p[1]} for p in s.get("pts", [])] or [{"x": float(s.get("x0", 0)), "y": float(s.get("top", 0))}, {"x": float(s.get("x1", 0)), "y": float(s.get("bottom", 0))}]
                    connectors.append({"type": kind, "id": f"c{len(connectors) + 1}", "bbox": placed(b), "points": points, "arrow": bool(s.get("arrow")), "metadata": {"source": f"pdf_vector_{kind}"}})
        return diagrams.structured(nodes, diagrams.edges_between(nodes, connectors, []), connectors)

    def segments(self) -> list[tuple]:
        """(top, bottom, kind, payload, confidence) from top to bottom."""
        found = []
        for b in self.diagram_boxes():
            made = self.diagram(b)
            if not skips(made):
                found.append((b[1], b[3], "diagram", made, "medium"))
                self.reader.parsed.warn("pdf_diagram_inferred", "low", page=self.number, message="boxes and lines were taken for a diagram")
        found += self.images()
        for i, (b, _) in enumerate(self.tables):
            if i in self.parents:
                continue
            made = self.table(i)
            if made is None or page_tables.is_blank_artifact(made):
                continue
            text = page_tables.title(made, b[3] - b[1])
            found.append((b[1], b[3], "text", text, "high") if text else (b[1], b[3], "table", made, "high"))
        for top, bottom in layout.gaps([s[:2] for s in found], self.page.get("height", 0.0)):
            text = crop(self.page, (0.0, top, self.page["width"], bottom))
            if text:
                found.append((top, bottom, "text", text, "high"))
        return sorted(found, key=lambda s: s[0])


def box_of(table: dict) -> layout.Box:
    return tuple(table["bbox"])


def skips(diagram: dict) -> bool:
    """Whether boxes are no diagram after all: fewer than two, lines of text in frames, or a table's headings."""
    nodes = diagram["nodes"]
    if len(nodes) < 2:
        return True
    if len(nodes) >= 3 and not diagram["connectors"]:
        framed = lambda n: n["bbox"]["width"] >= 120 and 0 < n["bbox"]["height"] <= 24 and n["bbox"]["width"] >= 8 * n["bbox"]["height"] and len(n["text"].strip()) >= 12
        if all(map(framed, nodes)):
            return True
    hits = sum(re.sub(r"\s+", "", n["text"]) in TABLE_WORDS for n in nodes)
    return hits >= 3 and 2 * hits >= len(nodes)


def _repeats(segment: tuple, after: tuple | None) -> bool:
    """A short title that the text below it says again."""
    if segment[2] != "text" or not after or after[2] != "text":
        return False
    title, below = segment[3].strip(), after[3].strip()
    if title.endswith("대상") and 0 < len(title) <= 30 and "\n" not in title and title in below and re.match("[가-힣]\\.", below):
        return True
    bare = re.sub(r"\s+", "", title)
    return 0 < len(title) <= 160 and "\n" not in title and segment[1] - segment[0] <= 24 and len(bare) >= 6 and bare in re.sub(r"\s+", "", below)


class _Reader:
    def __init__(self) -> None:
        self.parsed = Parsed()

    def read(self, pages: list[dict], ocr: Ocr | None) -> Parsed:
        by_page = []
        failed = []
        for i, page in enumerate(pages):
            why = ocr_reason(page, ocr is not None)
            if why is None:
                by_page.append(_Page(self, i + 1, page).segments())
                continue
            if why != "scanned":
                self.parsed.warn("pdf_native_text_ocr_fallback", "low", page=i + 1, message="the page's own text looked damaged and was read from its picture")
            text = ""
            if ocr:
                try:
                    text = page_texts.clean(ocr(base64.b64decode(page.get("picture") or ""), i))
                except Exception as error:  # a page that can't be read is a warning, not a failed document
                    failed.append((i + 1, str(error)))
            segments = []
            for k, (kind, payload) in enumerate(page_texts.read_parts(text) if text else []):
                segments.append((k * 0.001, k * 0.001, kind[:5] if kind != "text" else "text", payload, "medium"))
                if kind != "text":
                    self.parsed.warn("pdf_ocr_table_inferred", "low", page=i + 1, message=f"a {'text' if kind == 'table_text' else 'pipe'} table was read from a picture")
            by_page.append(segments)
        for page, message in failed:
            self.parsed.warn("pdf_ocr_failed", page=page, message=message)
        n_tables = 0
        for number, segments in enumerate(self.expanded(self.continued(by_page)), 1):
            for top, bottom, kind, payload, confidence in segments:
                where = {"page": number, "confidence": confidence}
                if kind == "text":
                    text = payload.strip()
                    if text and not page_texts.is_artifact(text):
                        self.parsed.add("text", "plain", text, text, [], pdf={"page": number})
                elif kind == "table":
                    n_tables += 1
                    self.parsed.add("table", "structured_table", page_tables.source_text(payload, diagrams.words), payload, [], table={"table_id": f"t{n_tables}", "headers": [c["text"] for c in payload["columns"]], "row_count": len(payload["rows"])}, pdf=where)
                elif kind == "image":
                    self.parsed.add("image", "asset_ref", f"image: {payload['asset_id']}", payload, [], "image", asset={"asset_id": payload["asset_id"]}, pdf=where)
                elif words := diagrams.words(payload):
                    self.parsed.add("diagram", "structured_diagram", words, payload, [], diagram={"node_count": len(payload["nodes"]), "edge_count": len(payload["edges"]), "confidence": confidence}, pdf=where)
        return self.parsed

    @staticmethod
    def continued(pages: list[list[tuple]]) -> list[list[tuple]]:
        """A table that heads a page with the columns of the last one becomes rows of that."""
        out, last = [], None
        for segments in pages:
            kept, content_above = [], False
            for s in segments:
                if s[2] != "table":
                    kept.append(s)
                    if not (s[2] == "text" and page_texts.is_artifact(s[3])):
                        content_above, last = True, None
                elif last is not None and not content_above and page_tables.continues(last, s[3]):
                    page_tables.append_rows(last, s[3])
                else:
                    kept.append(s)
                    last = s[3]
            out.append(kept)
        return out

    @staticmethod
    def expanded(pages: list[list[tuple]]) -> list[list[tuple]]:
        out = []
        for segments in pages:
            parts: list[tuple] = []
            for s in segments:
                made = None
                if s[2] == "text":
                    made = page_texts.revision_parts(s[3]) or [("text", x) for x in page_texts.text_parts(s[3]) or ()]
                parts += [(s[0] + k * 0.001, s[1], kind, payload, s[4]) for k, (kind, payload) in enumerate(made)] if made else [s]
            parts.sort(key=lambda s: s[0])
            out.append([s for s, after in zip(parts, [*parts[1:], None]) if not _repeats(s, after)])
        return out


def parse_pages(pages: list[dict], ocr: Ocr | None = None) -> Parsed:
    return _Reader().read(pages, ocr)


def parse_json(data: bytes, ocr: Ocr | None = None) -> Parsed:
    return parse_pages(json.loads(data)["pages"], ocr) if data else Parsed()


def parse_with(extract: Callable[[bytes], list[dict]], ocr: Ocr | None = None) -> Callable[[bytes], Parsed]:
    """A reader of PDF bytes, by a function that yields their pages."""
    return lambda data: parse_pages(extract(data), ocr) if data else Parsed()
