"""Evidence rows: what every reader yields, and how documents are read.

A reader is a function of a document's bytes that returns a ``Parsed``:
ordered units, the assets they refer to, and warnings.  ``read`` applies the
reader of each row's suffix and yields one tagged table, so that a document
is parsed once whatever is asked of it later; ``units``, ``assets``,
``warnings`` and ``cells`` are views of that table.

Trees (tables in cells of tables) are JSON strings in ``content``; ``cells``
and ``nodes`` are their flat forms.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Parsed:
    units: list[dict] = field(default_factory=list)
    assets: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)

    def add(self, kind: str, form: str, source: str, content: Any, path: list[str], shown: str | None = None, **more: Any) -> dict:
        """Appends the next unit; more becomes part of its metadata."""
        common = {"chunk_kind": more.pop("chunk_kind", kind), "section_path": list(path), "display_format": shown or form}
        unit = {"id": f"b{len(self.units) + 1}", "type": kind, "format": form, "source": {"kind": kind, "text": source}, "content": content, "metadata": {"common": common, **more}}
        self.units.append(unit)
        return unit

    def asset(self, data: bytes, mime: str, ext: str, **metadata: Any) -> str:
        name = f"img-{len(self.assets) + 1:04d}"
        self.assets.append({"id": name, "kind": "image", "data": data, "mime": mime, "ext": ext, "metadata": metadata})
        return name

    def warn(self, kind: str, severity: str = "medium", **more: Any) -> None:
        self.warnings.append({"type": kind, "severity": severity, **more})


def child(kind: str, form: str, content: Any, **more: Any) -> dict:
    """What a cell holds besides text."""
    return {"type": kind, "format": form, "content": content, **more}


Reader = Callable[[bytes], Parsed]
#: A suffix, and how a row becomes the content of a document.
Made = tuple[str, Callable[[dict], bytes]]

COLUMNS = "doc_id long, kind string, ord int, id string, type string, format string, source_text string, content string, section_path array<string>, metadata string, data binary, mime string, ext string"
_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}
_SCHEMA = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in COLUMNS.split(", ")])


_encoded = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


class Written(dict):
    """A tree whose JSON is known, in text; nothing is to be changed in it, and none of its optional fields is there but empty."""

    __slots__ = ("text",)


def dumped(value: Any) -> str:
    return value.text if type(value) is Written else _encoded(value)


def rows_of(doc_id: int, parsed: Parsed) -> list[dict]:
    out = []
    for i, u in enumerate(parsed.units, 1):
        content = u["content"] if isinstance(u["content"], str) else dumped(u["content"])
        out.append({"doc_id": doc_id, "kind": "unit", "ord": i, "id": u["id"], "type": u["type"], "format": u["format"], "source_text": u["source"]["text"], "content": content, "section_path": u["metadata"]["common"]["section_path"], "metadata": dumped(u["metadata"])})
    for i, a in enumerate(parsed.assets, 1):
        out.append({"doc_id": doc_id, "kind": "asset", "ord": i, "id": a["id"], "type": a["kind"], "metadata": dumped(a["metadata"]), "data": a["data"], "mime": a["mime"], "ext": a["ext"]})
    for i, w in enumerate(parsed.warnings, 1):
        out.append({"doc_id": doc_id, "kind": "warning", "ord": i, "type": w["type"], "format": w.get("severity"), "metadata": dumped(w)})
    return out


def unit_of(row: Mapping) -> dict:
    """The unit that a row of ``units`` stands for."""
    content = row["content"] if row["format"] == "plain" else json.loads(row["content"])
    return {"id": row["id"], "type": row["type"], "format": row["format"], "source": {"kind": row["type"], "text": row["source_text"]}, "content": content, "metadata": json.loads(row["metadata"])}


class UnknownSuffix(ValueError):
    pass


#: Rows that a pass holds as Python objects at a time; Spark hands over up to 10,000, which may be a GB of them.
SLICE = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of no more than so many rows, and of about so many bytes."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for part in sliced(batches):
        yield from part.to_pylist()


def in_batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1_000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows as record batches of no more than about so many rows and characters."""
    names = schema.names
    held: list[list] = [[] for _ in names]
    keep = [(x.append, n) for x, n in zip(held, names)]
    count = weight = 0
    for row in rows:
        for add, name in keep:
            value = row.get(name)
            add(value)
            if type(value) in (str, bytes):
                weight += len(value)
        count += 1
        if count >= most or weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, schema.types)], schema=schema)
            for x in held:
                x.clear()
            count = weight = 0
    if count:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, schema.types)], schema=schema)


def parsed(readers: Mapping[str, Reader], made: Made | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, Parsed]]]:
    """Of batches of docs (doc_id, suffix, content), or of rows that documents are made from, each document's id and what its reader finds."""
    known = dict(readers)

    def each_made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Parsed]]:
        suffix, build = made
        for row in rows_in(batches):
            yield row["doc_id"], known[suffix](build(row))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Parsed]]:
        for batch in sliced(batches):
            for doc_id, suffix, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                name = (suffix or "").lower()
                name = name if name.startswith(".") else f".{name}"
                if name not in known:
                    raise UnknownSuffix(f"no reader for {name!r}; there are readers for {', '.join(sorted(known))}")
                yield doc_id, known[name](content.encode() if isinstance(content, str) else content or b"")

    return each_made if made else each


def read(docs: DataFrame, readers: Mapping[str, Reader], made: Made | None = None) -> DataFrame:
    """Evidence rows of docs (doc_id, suffix, content); text content counts as UTF-8 bytes.

    A suffix without a reader fails the job, as does null content of a known one
    not: null and empty documents have no units.  With made, docs has doc_id and
    what that takes to make a document: it is read where it is made, and no more
    than one is held.
    """
    each = parsed(readers, made)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches((row for doc_id, found in each(batches) for row in rows_of(doc_id, found)), _SCHEMA)

    return (docs if made else docs.select("doc_id", "suffix", "content")).mapInArrow(apply, COLUMNS)


def units(evidence: DataFrame) -> DataFrame:
    return evidence.where("kind = 'unit'").select("doc_id", "ord", "id", "type", "format", "source_text", "content", "section_path", "metadata")


def assets(evidence: DataFrame) -> DataFrame:
    return evidence.where("kind = 'asset'").select("doc_id", "ord", "id", "type", "mime", "ext", "data", "metadata")


def warnings(evidence: DataFrame) -> DataFrame:
    return evidence.where("kind = 'warning'").select("doc_id", "ord", "type", F.col("format").alias("severity"), "metadata")


_TABLE = "caption string, columns array<struct<id: string, text: string>>, header_rows array<struct<index: int, cells: array<struct<column_id: string, text: string, rowspan: int, colspan: int, children: string>>>>, rows array<struct<index: int, cells: array<struct<column_id: string, text: string, rowspan: int, colspan: int, children: string>>>>"


def tables(found: DataFrame) -> DataFrame:
    """The table units with their parsed content in ``t``."""
    return found.where("type = 'table'").withColumn("t", F.from_json("content", _TABLE))


def cells(found: DataFrame) -> DataFrame:
    """One row per cell of the outermost tables: doc_id, id, section, row_index, pos, column_id, text, rowspan, colspan, n_children."""
    both = F.concat(
        F.transform(F.coalesce("t.header_rows", F.array()), lambda r: F.struct(F.lit("header").alias("section"), r.alias("r"))),
        F.transform(F.coalesce("t.rows", F.array()), lambda r: F.struct(F.lit("body").alias("section"), r.alias("r"))),
    )
    rows = tables(found).select("doc_id", "id", F.explode(both).alias("row"))
    each = rows.select("doc_id", "id", "row.section", F.col("row.r.index").alias("row_index"), F.posexplode("row.r.cells").alias("pos", "c"))
    n = F.coalesce(F.size(F.from_json("c.children", "array<string>")), F.lit(0))
    return each.select("doc_id", "id", "section", "row_index", "pos", "c.column_id", "c.text", F.coalesce("c.rowspan", F.lit(1)).alias("rowspan"), F.coalesce("c.colspan", F.lit(1)).alias("colspan"), n.alias("n_children"))


NODE = "doc_id long, id string, node string, parent string, depth int, type string, format string, n_rows int, n_columns int, asset_id string"
_NODE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("id", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("type", pa.string()), ("format", pa.string()), ("n_rows", pa.int32()), ("n_columns", pa.int32()), ("asset_id", pa.string())])


def nested(value: Any) -> list[dict]:
    """The children that a table's cells hold, in order."""
    if not isinstance(value, Mapping):
        return []
    rows = [*value.get("header_rows", []), *value.get("rows", [])]
    return [child for row in rows for cell in row.get("cells", []) for child in cell.get("children", [])]


def nodes(found: DataFrame) -> DataFrame:
    """Every unit and everything nested in it, one row each, tied to its parent."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in rows_in(batches):
            stack = [(f"{row['id']}", None, 0, row["type"], row["format"], row["content"] if row["format"] == "plain" else json.loads(row["content"]))]
            while stack:
                name, parent, depth, kind, form, content = stack.pop()
                tree = content if isinstance(content, Mapping) else {}
                yield {"doc_id": row["doc_id"], "id": row["id"], "node": name, "parent": parent, "depth": depth, "type": kind, "format": form, "n_rows": len(tree.get("rows", [])), "n_columns": len(tree.get("columns", [])), "asset_id": tree.get("asset_id")}
                stack += [(f"{name}.{i}", name, depth + 1, c.get("type", c.get("kind")), c.get("format"), c.get("content")) for i, c in enumerate(nested(tree), 1)][::-1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(each(batches), _NODE_SCHEMA)

    return found.select("doc_id", "id", "type", "format", "content").mapInArrow(apply, NODE)
