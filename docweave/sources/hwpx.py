"""HWPX documents: a zip of section XML with pictures beside it.

Of what a paragraph holds the first of table, picture, drawing and text
counts.  Tables with a work-flow title in their body give a diagram.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from docweave.operators import diagrams, grid
from docweave.operators.grid import GridCell, any_of
from docweave.sources.evidence import Parsed, child

NODES = frozenset("rect roundRect ellipse arc polygon curve container shapeObject textBox textbox".split())
CONNECTORS = frozenset("line connectLine arc curve polygon".split())
UNSUPPORTED = frozenset("textart equation ole video edit button checkBtn radio comboBox listBox scrollBar".split())
_MIMES = ((b"\x89PNG\r\n\x1a\n", "image/png", "png"), (b"\xff\xd8\xff", "image/jpeg", "jpg"), (b"GIF8", "image/gif", "gif"), (b"GIF9", "image/gif", "gif"), (b"BM", "image/bmp", "bmp"))


def mime_of(data: bytes) -> tuple[str, str]:
    return next(((mime, ext) for start, mime, ext in _MIMES if data.startswith(start)), ("application/octet-stream", "bin"))


def local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _named(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in e if local(c) == name]


def _within(e: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((d for d in e.iter() if d is not e and local(d) == name), None)


def _printable(text: str | None) -> str:
    return "".join(c for c in text or "" if c > "\x1f")


def _number(e: ElementTree.Element | None, *names: str) -> int | None:
    for name in names:
        if e is not None and e.get(name) is not None:
            try:
                return int(float(e.get(name)))
            except ValueError:
                continue
    return None


class _Reader:
    def __init__(self, archive: zipfile.ZipFile):
        self.archive, self.names, self.parsed = archive, set(archive.namelist()), Parsed()
        self.n_tables = 0
        self.pictures = {}
        if "Contents/content.hpf" in self.names:
            for e in ElementTree.fromstring(archive.read("Contents/content.hpf")).iter():
                if local(e) == "item" and e.get("id") and e.get("href", "").startswith("BinData/"):
                    self.pictures[e.get("id")] = e.get("href")

    def sections(self) -> list[str]:
        numbered = {n: int(m[1]) for n in self.names if (m := re.fullmatch(r"Contents/section(\d+)\.xml", n))}
        return sorted(numbered, key=numbered.get)

    # Pieces of a paragraph

    @staticmethod
    def text(paragraph: ElementTree.Element) -> str:
        runs = [r for r in _named(paragraph, "run") if not _named(r, "tbl") and not _named(r, "pic")]
        return "".join(_printable(t.text) for r in runs for t in _named(r, "t")).strip()

    def picture(self, e: ElementTree.Element) -> str | None:
        ref = next((x.get("binaryItemIDRef") for x in e.iter() if local(x) in ("img", "image") and x.get("binaryItemIDRef")), "")
        path = self.pictures.get(ref, "")
        if path not in self.names:
            self.parsed.warn("hwpx_image_reference_unresolved", ref=ref, message=f"no picture for {ref!r}")
            return None
        data = self.archive.read(path)
        return self.parsed.asset(data, *mime_of(data), source_path=path)

    def drawing(self, paragraph: ElementTree.Element) -> str | dict | None:
        """The text of a drawing that is one box of text, the diagram of any other with text."""
        shapes: list[ElementTree.Element] = []

        def collect(e: ElementTree.Element) -> None:
            name = local(e)
            if name in ("drawText", "pic", "tbl"):
                return
            if name in CONNECTORS or name in UNSUPPORTED or name in NODES and (name != "container" or self.shape_text(e)):
                shapes.append(e)
                return
            for child in e:
                collect(child)

        for run in _named(paragraph, "run"):
            for child in run:
                collect(child)
        nodes, connectors = [], []
        for e in shapes:
            name = local(e)
            if name in UNSUPPORTED:
                warning = {"type": "hwpx_drawing_structure_unsupported", "severity": "medium", "element": name, "message": f"drawings of kind {name} are not read"}
                if warning not in self.parsed.warnings:
                    self.parsed.warnings.append(warning)
            elif name in NODES and (text := self.shape_text(e)):
                nodes.append({"shape_type": name, "text": text, "id": f"n{len(nodes) + 1}", "bbox": self.bbox(e), "metadata": {"source": "hwpx_drawing_text"}})
            elif name in CONNECTORS and (b := self.bbox(e, flat=True)):
                kind = "line" if name == "connectLine" else name
                ends = self.ends(e) or diagrams.line_ends(b["x"], b["y"], b["width"], b["height"])
                connectors.append({"type": kind, "id": f"c{len(connectors) + 1}", "points": ends, "bbox": b, "arrow": self.arrow(e), "metadata": {"source": f"hwpx_{kind}"}})
        if len(nodes) == 1 and not connectors:
            return nodes[0]["text"]
        if not nodes:
            return None
        return diagrams.structured(nodes, diagrams.edges_between(nodes, connectors, diagrams.step_labels(nodes)), connectors)

    @staticmethod
    def shape_text(e: ElementTree.Element) -> str:
        return " ".join(" ".join(_printable(t.text) for t in e.iter() if local(t) == "t" and t.text).split())

    @staticmethod
    def bbox(e: ElementTree.Element, flat: bool = False) -> dict | None:
        """Attributes of the shape itself go before those of its position and size."""
        at, size = _within(e, "pos"), _within(e, "sz")
        pick = lambda inner, *names: next((v for v in (_number(e, *names), _number(inner, *names)) if v is not None), 0)
        x, y = pick(at, "x", "left"), pick(at, "y", "top")
        w, h = pick(size, "width", "w", "cx"), pick(size, "height", "h", "cy")
        if (w <= 0 and h <= 0) if flat else (w <= 0 or h <= 0):
            return None
        return {"x": x, "y": y, "width": w, "height": h, "unit": "hwpx"}

    @staticmethod
    def ends(e: ElementTree.Element) -> list[dict]:
        points = [{"x": x, "y": y} for p in e.iter() if local(p) in ("pt", "point") and (x := _number(p, "x")) is not None and (y := _number(p, "y")) is not None]
        if len(points) >= 2:
            return points
        sides = [(_number(e, *xs), _number(e, *ys)) for xs, ys in ((f"x{n} {word}X {to}X".split(), f"y{n} {word}Y {to}Y".split()) for n, word, to in ((1, "start", "from"), (2, "end", "to")))]
        return [{"x": x, "y": y} for x, y in sides] if all(v is not None for side in sides for v in side) else []

    @staticmethod
    def arrow(e: ElementTree.Element) -> bool:
        return any("arrow" in k.rsplit("}", 1)[-1].lower() and v.strip().lower() not in ("", "0", "false", "none", "null") for d in e.iter() for k, v in d.attrib.items())

    # Tables

    def rows(self, table: ElementTree.Element) -> list[grid.Row]:
        out = []
        for i, tr in enumerate(_named(table, "tr")):
            row, at = [], 0
            for tc in _named(tr, "tc"):
                cell = self.cell(tc, i, at)
                row.append(cell)
                at = cell.end
            if row:
                out.append(row)
        return out

    def cell(self, tc: ElementTree.Element, row: int, column: int) -> GridCell:
        def own(name: str, child: str, least: int, default: int) -> int:
            value = tc.get(name)
            if value is None:
                inner = next(iter(_named(tc, child)), None)
                value = inner.get(name) if inner is not None else None
            return max(least, any_of(value, default)) if value is not None else default

        texts, children = [], []
        for lists in _named(tc, "subList")[:1]:
            for p in _named(lists, "p"):
                nested = _within(p, "tbl")
                if nested is not None:
                    children.append(child("table", "structured_table", self.table(nested)))
                    continue
                drawn = self.drawing(p)
                if isinstance(drawn, str):
                    texts.append(drawn)
                    continue
                if drawn is not None:
                    children.append(child("diagram", "structured_diagram", drawn))
                    continue
                for pic in (d for d in p.iter() if local(d) == "pic"):
                    name = self.picture(pic)
                    if name:
                        children.append(child("image", "asset_ref", {"asset_id": name, "caption": None}))
                if text := self.text(p):
                    texts.append(text)
        return GridCell(own("rowAddr", "cellAddr", 0, row), own("colAddr", "cellAddr", 0, column), own("rowSpan", "cellSpan", 1, 1), own("colSpan", "cellSpan", 1, 1), " ".join(texts), children)

    def table(self, table: ElementTree.Element) -> dict:
        rows = self.rows(table)
        return grid.content(rows, grid.header_rows(rows))

    def table_units(self, table: ElementTree.Element) -> None:
        rows = self.rows(table)
        if not rows:
            return
        heads = grid.header_rows(rows)
        body = rows[heads:]
        start, stop = diagrams.flow_range([[t for c in r if (t := diagrams.flow_cell(c.text))] for r in body])
        flow = None
        if stop:
            top = min(c.row for r in body[start:stop] for c in r)
            flow = diagrams.table_flow([(diagrams.flow_cell(c.text), c.column, max(0, c.row - top), c.colspan, c.rowspan) for r in body[start:stop] for c in sorted(r, key=lambda c: c.column)])
        content = grid.content(rows, heads)
        if flow:
            content["rows"] = content["rows"][:start] + content["rows"][stop:]
        if content["rows"] or not flow:
            text = grid.lone_text(content)
            if text is not None:
                self.parsed.add("text", "plain", text, text, [])
            else:
                self.n_tables += 1
                self.parsed.add("table", "structured_table", grid.source_text(content, diagrams.words), content, [], table={"table_id": f"t{self.n_tables}", "headers": [c["text"] for c in content["columns"]], "row_count": len(content["rows"])})
        if flow:
            self.diagram_unit(flow)

    def diagram_unit(self, diagram: dict) -> None:
        self.parsed.add("diagram", "structured_diagram", diagrams.words(diagram), diagram, [], diagram={"node_count": len(diagram["nodes"]), "edge_count": len(diagram["edges"])})

    def paragraph(self, p: ElementTree.Element) -> None:
        table = _within(p, "tbl")
        if table is not None:
            self.table_units(table)
            return
        picture = _within(p, "pic")
        if picture is not None:
            name = self.picture(picture)
            if name:
                self.parsed.add("image", "asset_ref", f"image: {name}", {"asset_id": name, "caption": None}, [], "image", asset={"asset_id": name})
            return
        drawn = self.drawing(p)
        if isinstance(drawn, dict):
            self.diagram_unit(drawn)
        elif text := drawn or self.text(p):
            self.parsed.add("text", "plain", text, text, [])


def parse(data: bytes, ocr: Callable[[bytes, int], str] | None = None) -> Parsed:
    """Units of an archive; with ocr, pictures are read where the document has no text of its own."""
    if not data:
        return Parsed()
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        reader = _Reader(archive)
        for name in reader.sections():
            for p in _named(ElementTree.fromstring(archive.read(name)), "p"):
                reader.paragraph(p)
    parsed = reader.parsed
    if ocr and not any(u["type"] != "image" and u["source"]["text"].strip() for u in parsed.units):
        for i, asset in enumerate(list(parsed.assets)):
            try:
                text, why = " ".join((ocr(asset["data"], i) or "").split()), "empty OCR result"
            except Exception as error:  # a picture that can't be read is a warning, not a failed document
                text, why = "", str(error)
            if text:
                parsed.add("text", "plain", text, text, [])
            else:
                parsed.warn("hwpx_ocr_failed", image_index=i + 1, asset_id=asset["id"], message=why)
    return parsed
