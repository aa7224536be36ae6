"""Plain text and Markdown.

A heading line ends the block before it and names the section of all that
follows, lines that begin with a bar make a table, other lines that aren't
blank make a paragraph.  Blocks are runs of one kind.  A text is folded line
by line where it lies, so nothing is shuffled and rows of one id keep apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as t


def split_row(line: Column) -> Column:
    """The cells of a table line."""
    bare = F.regexp_replace(t.strip(line), r"^\|+|\|+$", "")
    return F.transform(F.split(bare, r"\|"), t.strip)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit: doc_id, ord, type, section, content (paragraph text or table lines), n_lines.

    A line is classed by what is left of it after stripping, but a heading's
    marks only go where the line begins with them.
    """
    kind = docs.schema[id_col].dataType

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for row in blocks(text or ""):
                    at.append(i)
                    rows.append(row)
                if len(rows) >= 10_000:
                    yield _batch(batch, at, rows)
                    at, rows = [], []
            if rows:
                yield _batch(batch, at, rows)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(apply, f"doc_id {kind.simpleString()}, ord int, type string, section string, content string, n_lines long")


def _batch(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], names=["doc_id", "ord", "type", "section", "content", "n_lines"])


def blocks(text: str) -> Iterator[tuple[int, str, str, str, int]]:
    """ord, type, section, content and number of lines of each unit of a text."""
    section, kind, held, n = "", None, [], 0
    for line in [*text.splitlines(), ""]:
        bare = line.strip()
        own = "heading" if bare.startswith("#") else "table" if bare.startswith("|") else "text" if bare else None
        if own != kind and held:
            n += 1
            yield n, kind, section, "\n".join(held), len(held)
            held = []
        kind = own
        if own == "heading":
            section = re.sub("^#+", "", line).strip()
        elif own:
            held.append(bare)


def table_cells(scanned: DataFrame) -> DataFrame:
    """doc_id, ord, row_index, column_id, header, text for tables of three lines or more; the second line only rules off the header."""
    rows = scanned.where("type = 'table' and n_lines >= 3").select("doc_id", "ord", F.split("content", "\n").alias("ls"))
    head = rows.withColumn("headers", split_row(F.col("ls")[0])).select("doc_id", "ord", "headers", F.posexplode(F.slice("ls", 3, F.size("ls"))).alias("r", "line"))
    cells = F.filter(F.arrays_zip(F.col("headers").alias("header"), split_row(F.col("line")).alias("text")), lambda x: x["header"].isNotNull() & x["text"].isNotNull())
    each = head.select("doc_id", "ord", (F.col("r") + 1).alias("row_index"), F.posexplode(cells).alias("c", "cell"))
    return each.select("doc_id", "ord", "row_index", F.concat(F.lit("c"), F.col("c") + 1).alias("column_id"), "cell.header", "cell.text")
