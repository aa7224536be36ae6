"""HWP5 documents: record streams in a compound file.

A section's records carry levels.  A control record opens a table or a
drawing, what follows on deeper levels belongs to it, and a record on its
level or above closes it.  Runs of drawn texts and lines become diagrams.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from docweave.operators import diagrams, grid
from docweave.operators.grid import GridCell
from docweave.sources.compound import CompoundFile
from docweave.sources.evidence import Parsed, child
from docweave.sources.hwpx import mime_of

BIN_DATA, PARA_TEXT, CONTROL, LIST, SHAPE, TABLE, LINE, PICTURE = 0x12, 0x43, 0x47, 0x48, 0x4C, 0x4D, 0x4E, 0x55
# Names are stored backwards.
SHAPES = {name[::-1].encode(): kind for name, kind in {"$rec": "rectangle", "$ell": "ellipse", "$txt": "textbox", "$grp": "group", "$con": "container", "$pol": "polygon", "$pic": "picture", "$lin": "line", "$col": "connector", "$arc": "arc", "$cur": "curve"}.items()}


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """tag, level and payload of each record; a size of all ones is followed by the size proper."""
    at = 0
    while at + 4 <= len(data):
        head = int.from_bytes(data[at : at + 4], "little")
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                return
            size = int.from_bytes(data[at : at + 4], "little")
            at += 4
        yield head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size]
        at += size


def packed(tag: int, level: int, payload: bytes) -> bytes:
    """A record as bytes."""
    n = len(payload)
    head = tag | level << 10 | min(n, 0xFFF) << 20
    return struct.pack("<I", head) + (struct.pack("<I", n) if n >= 0xFFF else b"") + payload


def clean(text: str) -> str:
    return re.sub(r"[ \t\r\f\v]+", " ", "".join(c for c in text if c == "\n" or c > "\x1f")).strip()


def paragraph_text(payload: bytes) -> str:
    """UTF-16; a control character stands for eight units."""
    try:
        chars = payload[: len(payload) // 2 * 2].decode("utf-16-le")
    except UnicodeDecodeError:
        return ""
    out, at = [], 0
    while at < len(chars):
        if "\x01" <= chars[at] <= "\x1f":
            at += 8
        else:
            out.append(chars[at])
            at += 1
    return clean("".join(out))


def inflated(raw: bytes, lenient: bool = False) -> bytes:
    for bits in (-15, 15):
        try:
            return zlib.decompress(raw, bits)
        except zlib.error:
            continue
    if lenient:
        return raw
    raise ValueError("a compressed stream can't be read")


def _u(payload: bytes, at: int, size: int = 4) -> int:
    return int.from_bytes(payload[at : at + size], "little")


def _extent(payload: bytes, order: tuple[int, int, int, int]) -> dict | None:
    if len(payload) < max(order) + 4:
        return None
    x, y, w, h = (_u(payload, i) for i in order)
    return {"x": x, "y": y, "width": w, "height": h, "unit": "hwp"} if w or h else None


def drawing_box(payload: bytes) -> dict | None:
    return _extent(payload, (8, 12, 16, 20))


def shape_box(payload: bytes) -> dict | None:
    return _extent(payload, (8, 4, 12, 16)) or drawing_box(payload)


def instance_of(payload: bytes) -> int | None:
    return (_u(payload, 32) or None) if len(payload) >= 36 else None


def line_facts(payload: bytes | None) -> dict:
    """What a line's record says, as far as it goes."""
    p = payload or b""
    facts: dict = {"payload_bytes": len(p)} if payload is not None else {}
    if len(p) >= 16:
        a, b, c, d = struct.unpack_from("<4i", p)
        facts |= {"raw_start_point": {"x": a, "y": b}, "raw_end_point": {"x": c, "y": d}}
    if len(p) >= 20:
        facts["link_type"] = _u(p, 16)
    if len(p) >= 36:
        facts |= {name: _u(p, 20 + 4 * i) for i, name in enumerate(("start_subject_id", "start_subject_index", "end_subject_id", "end_subject_index"))}
    return facts


def line_ends(b: dict | None, payload: bytes | None) -> list[dict]:
    raw = struct.unpack_from("<4i", payload) if payload is not None and len(payload) >= 16 else None
    if b is None:
        return [{"x": raw[0], "y": raw[1]}, {"x": raw[2], "y": raw[3]}] if raw else []
    x, y, w, h = b["x"], b["y"], b["width"], b["height"]
    slanted = w < 3 * max(h, 1) and h < 3 * max(w, 1)
    if slanted and raw and max(map(abs, raw)) >= 1000:
        return [{"x": x + raw[0], "y": y + raw[1]}, {"x": x + raw[2], "y": y + raw[3]}]
    return diagrams.line_ends(x, y, w, h)


@dataclass
class Text:
    text: str
    drawn: bool = False
    bbox: dict | None = None
    shape: str = "label"
    metadata: dict = field(default_factory=dict)

    @property
    def short(self) -> bool:
        return not self.drawn and 0 < len(self.text) <= 80

    def node(self, n: int) -> dict:
        return {"id": f"n{n}", "shape_type": self.shape, "text": self.text, "bbox": self.bbox, "metadata": {"source": "hwp5_drawing_text" if self.drawn else "hwp5_body_text", **self.metadata}}


@dataclass
class Line:
    bbox: dict | None
    payload: bytes | None
    metadata: dict

    def connector(self, n: int) -> dict:
        facts = line_facts(self.payload)
        arrow = facts.get("link_type", 0) % 3 != 0
        return {"id": f"c{n}", "type": "arrow" if arrow else "line", "bbox": self.bbox, "points": line_ends(self.bbox, self.payload), "arrow": arrow, "metadata": {"source": "hwp5_gso_line", **self.metadata, **facts}}


@dataclass
class Picture:
    asset: str
    metadata: dict


@dataclass
class Table:
    level: int
    cells: list[GridCell] = field(default_factory=list)
    n_rows: int | None = None
    n_columns: int | None = None
    parts: list[str] = field(default_factory=list)
    open: GridCell | None = None

    def close_cell(self) -> None:
        if self.open:
            self.open.text = clean("\n".join(self.parts))
            self.cells.append(self.open)
        self.open, self.parts = None, []

    @property
    def filled(self) -> bool:
        return any(c.filled for c in self.cells)

    def fits(self, c: GridCell) -> bool:
        rows, columns = self.n_rows or 0, self.n_columns or 0
        return c.rowspan > 0 and c.colspan > 0 and (not rows or c.row + c.rowspan <= rows) and (not columns or c.end <= columns)

    def rows(self) -> list[grid.Row]:
        n_rows = self.n_rows or max((c.row + 1 for c in self.cells), default=0)
        n_columns = self.n_columns or max((c.end for c in self.cells), default=0)
        rows = grid.normalized([self.cells], n_rows, n_columns)
        if self.n_rows is None:
            heads = grid.header_rows(rows, blank_extends=False, contained=False)
            rows = rows[:heads] + [r for r in rows[heads:] if any(c.filled for c in r)]
        return rows

    def content(self) -> dict:
        rows = self.rows()
        heads = grid.header_rows(rows, blank_extends=False, contained=False)
        shown = [r for r in rows[:heads] if any(c.filled for c in r)] if heads else []
        gone = heads - len(shown)
        if gone:  # blank header rows go, and spans over them shrink
            blank = {r[0].row for r in rows[:heads] if r and not any(c.filled for c in r)}
            for r in shown:
                for c in r:
                    c.rowspan = max(1, c.rowspan - sum(c.row < k < c.row + c.rowspan for k in blank))
        return grid.compacted(grid.content(shown + rows[heads:], len(shown), single_row_spreads=False))

    def lone(self) -> str | None:
        rows = self.rows()
        if len(rows) == 1 and len(rows[0]) == 1 and not rows[0][0].children:
            return rows[0][0].text.strip() or None
        return None


def edges_of(nodes: list[dict], connectors: list[dict]) -> list[dict]:
    """By the ids a connector carries, else by what lies nearest to its ends."""
    labels = diagrams.step_labels(nodes, diagrams.split_steps)
    known = {n["metadata"]["instance_id"]: n["id"] for n in nodes if n["metadata"].get("instance_id")}
    by_place = {e["connector_id"]: e for e in diagrams.edges_between(nodes, connectors, labels)}
    out = []
    for i, c in enumerate(connectors):
        a, z = (known.get(c["metadata"].get(f"{side}_subject_id") or None) for side in ("start", "end"))
        if a and z and a != z:
            out.append({"from": a, "to": z, "type": "arrow" if c["arrow"] else "line", "label": labels[i] if i < len(labels) else "", "confidence": "parsed_subject_ids", "connector_id": c["id"]})
        elif c["id"] in by_place:
            out.append(by_place[c["id"]])
    return out


def diagram_of(nodes: list[dict], connectors: list[dict]) -> dict:
    return diagrams.structured(nodes, edges_of(nodes, connectors), connectors)


def why_unresolved(connector: dict, nodes: list[dict]) -> str:
    known = {n["metadata"]["instance_id"]: n["id"] for n in nodes if n["metadata"].get("instance_id")}
    ids = [connector["metadata"].get(f"{side}_subject_id") or 0 for side in ("start", "end")]
    if any(ids):
        if any(i not in known for i in ids):
            return "subject_id_unmatched"
        if known[ids[0]] == known[ids[1]]:
            return "subject_ids_resolve_to_same_node"
    boxes = [(n["id"], b) for n in nodes if (b := diagrams.box(n))]
    if len(boxes) < 2:
        return "insufficient_bbox_nodes"
    if len(connector["points"]) < 2:
        return "invalid_points"
    same = diagrams.nearest(connector["points"][0], boxes) == diagrams.nearest(connector["points"][1], boxes)
    return "endpoints_resolve_to_same_node" if same else "edge_inference_unresolved"


def source_text(table: dict) -> str:
    """As other tables', but a cell that spans rows is said again in each of them."""
    rows, active = [], []
    for row in table["rows"]:
        span = lambda c: (int(c["column_id"][1:]), int(c["column_id"][1:]) + c["colspan"])
        own = [span(c) for c in row["cells"]]
        carried = [c for last, c in active if last >= row["index"] and not any(span(c)[0] < z and a < span(c)[1] for a, z in own)]
        rows.append({**row, "cells": sorted([*carried, *row["cells"]], key=lambda c: span(c)[0])})
        active = [(last, c) for last, c in active if last > row["index"]] + [(row["index"] + c["rowspan"] - 1, c) for c in row["cells"] if c["rowspan"] > 1]
    return grid.source_text({**table, "rows": rows}, diagrams.words)


class _Section:
    """Reads the records of one section into blocks."""

    def __init__(self, owner: _Document):
        self.owner = owner
        self.blocks: list = []
        self.tables: list[Table] = []
        self.shape: dict | None = None  # the drawing that is open
        self.groups: list[tuple[int, dict]] = []

    def run(self, data: bytes) -> list:
        for tag, level, payload in records(data):
            self.close_to(tag, level)
            if tag == CONTROL:
                self.control(level, payload)
            else:
                self.body(tag, level, payload)
        while self.tables:
            self.close_table()
        self.close_shape()
        return self.blocks

    def close_to(self, tag: int, level: int) -> None:
        if self.shape and level <= self.shape["level"] and tag != CONTROL:
            self.close_shape()
        while self.groups and level <= self.groups[-1][0]:
            self.groups.pop()
        while self.tables and level <= self.tables[-1].level:
            self.close_table()

    def open_shape(self, level: int) -> dict:
        parent = next((facts for at, facts in reversed(self.groups) if at < level), {})
        return {"level": level, "texts": [], "bbox": None, "kind": None, "line": None, "ids": {}, "facts": dict(parent)}

    @staticmethod
    def ids(payload: bytes) -> dict:
        out = {"instance_id": instance_of(payload), "ctrl_id": payload[:4].decode("ascii", "replace")}
        return {k: v for k, v in out.items() if v is not None}

    def control(self, level: int, payload: bytes) -> None:
        name = payload[:4]
        if name == b" osg":
            self.close_shape()
            self.shape = self.open_shape(level) | {"bbox": drawing_box(payload), "ids": self.ids(payload)}
        elif name in SHAPES:
            if self.shape and level <= self.shape["level"]:
                self.close_shape()
            elif self.shape and self.shape["kind"] in ("group", "container"):
                group = self.shape
                self.put_text(group, {"container": True})
                self.groups.append((group["level"], {f"parent_{k}": v for k, v in group["ids"].items()}))
                self.shape = self.open_shape(level)
            if not self.shape:
                self.shape = self.open_shape(level)
            self.shape |= {"bbox": shape_box(payload) or self.shape["bbox"], "kind": SHAPES[name], "ids": self.ids(payload)}
        elif name == b" lbt":
            self.tables.append(Table(level))

    def body(self, tag: int, level: int, payload: bytes) -> None:
        top = self.tables[-1] if self.tables else None
        own = top is not None and level == top.level + 1
        if own and tag == TABLE:
            if len(payload) >= 8:
                top.n_rows, top.n_columns = _u(payload, 4, 2), _u(payload, 6, 2)
        elif self.shape and tag == PICTURE:
            self.picture(payload)
            self.shape = None
        elif self.shape and tag == SHAPE:
            name = payload[:4]
            if name in SHAPES:
                self.shape["kind"] = SHAPES[name]
                self.shape["ids"]["ctrl_id"] = name.decode("ascii", "replace")
            elif name:
                self.owner.parsed.warn("hwp5_unsupported_drawing_shape", ctrl_id=name.decode("ascii", "replace"), tag_id=tag, level=level, message="a drawing shape of unknown kind is kept as text")
        elif self.shape and tag == LINE:
            self.shape["line"] = payload
        elif own and tag == LIST:
            at = lambda i, default: _u(payload, i, 2) if len(payload) >= i + 2 else default
            cell = GridCell(at(10, 0), at(8, 0), at(14, 1), at(12, 1))
            if top.fits(cell):
                top.close_cell()
                top.open = cell
        elif tag == PARA_TEXT and (text := paragraph_text(payload)):
            if self.shape:
                self.shape["texts"].append(text)
            elif top and top.open:
                top.parts.append(text)
            else:
                self.blocks.append(Text(text))

    def in_cell(self) -> GridCell | None:
        return self.tables[-1].open if self.tables else None

    def put(self, block, as_diagram: Callable[[], dict]) -> None:
        cell = self.in_cell()
        if cell:
            cell.children.append(child("diagram", "structured_diagram", as_diagram()))
        else:
            self.blocks.append(block)

    def put_text(self, shape: dict, more: dict) -> None:
        text = clean(" ".join(shape["texts"]))
        block = Text(text, True, shape["bbox"], shape["kind"] or ("textbox" if text else "shape"), {**shape["facts"], **more, **shape["ids"]})
        self.put(block, lambda: diagram_of([block.node(1)], []))

    def close_shape(self) -> None:
        shape, self.shape = self.shape, None
        if not shape:
            return
        if shape["kind"] in ("line", "connector"):
            line = Line(shape["bbox"], shape["line"], {**shape["facts"], **shape["ids"]})
            self.put(line, lambda: diagram_of([], [line.connector(1)]))
        elif shape["texts"] or shape["bbox"] or shape["kind"] not in (None, "picture"):
            self.put_text(shape, {})

    def picture(self, payload: bytes) -> None:
        found = self.owner.picture(payload)
        if not found:
            self.owner.missing += 1
            return
        cell = self.in_cell()
        if cell:
            cell.children.append(child("image", "asset_ref", {"asset_id": found.asset, "caption": None}, metadata=found.metadata))
        else:
            self.blocks.append(found)

    def close_table(self) -> None:
        table = self.tables.pop()
        table.close_cell()
        if not table.filled:
            return
        if self.tables and self.tables[-1].open:
            self.tables[-1].open.children.append(child("table", "structured_table", table.content()))
        elif not self.tables:
            lone = table.lone()
            self.blocks.append(Text(lone) if lone else table)


def coalesced(blocks: list) -> list:
    """Drawn texts and lines that lie together as one diagram, with short texts between (six at most in a row) and before (three at most)."""
    out: list = []
    at = 0
    while at < len(blocks):
        first = blocks[at]
        if not (isinstance(first, Text) and first.drawn):
            out.append(first)
            at += 1
            continue
        end, gap, scan = at, 0, at + 1
        while scan < len(blocks):
            b = blocks[scan]
            if isinstance(b, Line) or isinstance(b, Text) and b.drawn:
                end, gap = scan, 0
            elif isinstance(b, Text) and b.short and gap < 6:
                gap += 1
            else:
                break
            scan += 1
        run = blocks[at : end + 1]
        lines = [b for b in run if isinstance(b, Line)]
        if sum(isinstance(b, Text) and b.drawn and bool(b.text) for b in run) < 2 and not lines:
            out.append(Text(first.text))
            at += 1
            continue
        before: list[Text] = []
        while out and len(before) < 3 and isinstance(out[-1], Text) and out[-1].short:
            before.insert(0, out.pop())
        texts = [*before, *(b for b in run if isinstance(b, Text))]
        nodes = [b.node(n) for n, b in enumerate(texts, 1) if b.text or b.bbox or b.shape not in ("label", "")]
        out.append(diagram_of(nodes, [b.connector(n) for n, b in enumerate(lines, 1)]))
        at = end + 1
    return out


class _Document:
    def __init__(self, data: bytes):
        self.streams = CompoundFile(data).streams
        self.parsed, self.missing = Parsed(), 0
        header = self.streams.get("FileHeader", b"")
        self.compressed = len(header) >= 40 and bool(_u(header, 36) & 1)
        self.entries: dict[int, tuple[int, str]] = {}
        n = 0
        for tag, _, payload in records(self.plain("DocInfo")) if "DocInfo" in self.streams else ():
            if tag == BIN_DATA:
                n += 1
                if len(payload) >= 4 and _u(payload, 0, 2) & 0x0F in (1, 2):
                    length = _u(payload, 4, 2) * 2
                    name = payload[6 : 6 + length] if len(payload) >= 6 + length else b""
                    self.entries[n] = _u(payload, 2, 2), name.decode("utf-16-le", "replace").lower()
        self.binaries = {int(m[1], 16): (name, m[2].lower()) for name in self.streams if (m := re.fullmatch(r"(?i:BinData/BIN([0-9a-f]{4})\.(\w+))", name))}

    def plain(self, name: str) -> bytes:
        raw = self.streams[name]
        return inflated(raw) if self.compressed else raw

    def picture(self, payload: bytes) -> Picture | None:
        if len(payload) < 73:
            return None
        n = _u(payload, 71, 2)
        storage, stored_ext = self.entries.get(n, (None, None))
        stream = next((s for s in (storage, n) if s in self.binaries), None)
        if stream is None:
            return None
        name, ext = self.binaries[stream]
        data = inflated(self.streams[name], lenient=True) if self.compressed else self.streams[name]
        mime, by_content = mime_of(data)
        facts = {"source": "hwp5_bindata", "bin_data_id": n, "storage_id": storage, "stream_id": stream}
        asset = self.parsed.asset(data, mime, by_content if by_content != "bin" else ext, **facts, doc_info_ext=stored_ext, stream_ext=ext)
        return Picture(asset, {"asset_id": asset, **facts, "ext": by_content if by_content != "bin" else ext})

    def read(self) -> Parsed:
        sections = {n: int(m[1]) for n in self.streams if (m := re.fullmatch(r"BodyText/Section(\d+)", n))}
        blocks = [b for name in sorted(sections, key=sections.get) for b in _Section(self).run(self.plain(name))]
        parsed, n_tables, drawn = self.parsed, 0, False
        for b in coalesced(blocks):
            if isinstance(b, Text) and b.text:
                parsed.add("text", "plain", b.text, b.text, [], "drawing_text" if b.drawn else None, chunk_kind="drawing" if b.drawn else "text")
            elif isinstance(b, Picture):
                parsed.add("image", "asset_ref", f"image: {b.asset}", {"asset_id": b.asset, "caption": None}, [], "image", asset=b.metadata)
            elif isinstance(b, Table):
                n_tables += 1
                content = b.content()
                parsed.add("table", "structured_table", source_text(content), content, [], table={"table_id": f"t{n_tables}", "headers": [c["text"] for c in content["columns"]], "row_count": len(content["rows"])})
            elif isinstance(b, dict) and (text := diagrams.words(b)):
                drawn = True
                unit = parsed.add("diagram", "structured_diagram", text, b, [], diagram={"node_count": len(b["nodes"]), "connector_count": len(b["connectors"]), "edge_count": len(b["edges"])})
                tied = {e["connector_id"] for e in b["edges"]}
                loose = [{**c, "resolution_failure": why_unresolved(c, b["nodes"])} for c in b["connectors"] if c["id"] not in tied]
                if loose:
                    parsed.warn("hwp5_diagram_connector_unresolved", unit_id=unit["id"], connector_ids=[c["id"] for c in loose], connectors=loose, message="connectors without an edge")
        if drawn:
            parsed.warn("hwp5_drawing_structure_partial", message="details of drawings may be missing")
        if self.missing:
            parsed.warn("hwp5_images_missing", message=f"{self.missing} pictures have no stream")
        return parsed


def parse(data: bytes, ocr: Callable[[bytes, int], str] | None = None) -> Parsed:
    """Units of a compound file; with ocr every picture is read, and what the document says itself is left out."""
    if not data:
        return Parsed()
    parsed = _Document(data).read()
    if ocr:
        bare = lambda text: re.sub(r"\s+", "", text)
        native = [bare(clean(u["source"]["text"])) for u in parsed.units if u["type"] != "image"]
        for i, asset in enumerate(list(parsed.assets)):
            try:
                text, why = clean(ocr(asset["data"], i) or ""), "empty OCR result"
            except Exception as error:  # a picture that can't be read is a warning, not a failed document
                text, why = "", str(error)
            if not text:
                parsed.warn("hwp5_ocr_failed", asset_id=asset["id"], stage="ocr", message=why)
            elif not any(bare(text) in x for x in native if x):
                parsed.add("text", "plain", text, text, [], chunk_kind="ocr", ocr={"source": "hwp5_image", "asset_id": asset["id"]})
    return parsed


def parse_or_skip(data: bytes) -> tuple[Parsed, str | None]:
    """What is no compound file is an empty document with a warning."""
    from docweave.sources.compound import MAGIC

    if not data.startswith(MAGIC):
        parsed = Parsed()
        parsed.warn("non_hwp5_skipped", "low", message="not a compound file")
        return parsed, "non_hwp5_container"
    return parse(data), None
