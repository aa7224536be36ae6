"""Repeated passages by overlapping three-line windows.

Every three consecutive lines of a text are a window, known by a 128-bit hash
of their bytes.  A window that the whole table has twice or more is repeated;
its first occurrence, by row and then by line, stays.  The lines of all later
occurrences are covered positions; covered positions that touch are merged
and removed.  Later occurrences may overlap the first: of five equal lines
the first window is kept as an occurrence, but the second and third cover its
last two lines, so that one line is left.

Rows come by id, a null id after all others, and rows that share an id by a
hash of their text (the first 60 bits of its MD5), so that each row's lines
are its own.  Rows with the same id and text are occurrences at the same
place: neither is later than the other, and what one loses the other loses.

What is shuffled is the hash and place of each window, once to find the first
occurrence of each repeated window (aggregated before the shuffle, so a
passage that a third of all rows share is one row per task) and once to find
the later ones; windows that very many rows share are broadcast there, and
their occurrences are spread over all tasks.  Texts are only needed again
where lines go.

Texts of fewer than three lines have no window; null texts have none either
and stay null.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._arrow import Texts, column, slices
from docweave.llm._spark import joined, written

WINDOW = 3


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, tie, line (of the window's first line, from 0), high and low halves of its hash, for docs of doc_id, tie and text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = Texts(column(part, "text"))
            row, line, high, low = [], [], [], []
            for i in range(texts.n):
                text = texts.text(i)
                ends = [k for k in np.flatnonzero(texts.data[texts.offsets[i] : texts.offsets[i + 1]] == 10).tolist()]
                n = len(ends) + 2 - width
                if n <= 0:
                    continue
                begins, stops = [0, *(k + 1 for k in ends)], [*ends, len(text)]
                for k in range(n):
                    digest = xxhash.xxh128_intdigest(text[begins[k] : stops[k + width - 1]])
                    high.append(digest >> 64)
                    low.append(digest & 0xFFFFFFFFFFFFFFFF)
                row.append(np.full(n, i))
                line.append(np.arange(n))
            if row:
                hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)]
                own = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id").take(own), column(part, "tie").take(own), pa.array(np.concatenate(line).astype(np.int32)), *hashes], names=["doc_id", "tie", "line", "high", "low"])

    return docs.mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie long, line int, high long, low long")


def _tied(docs: DataFrame, text) -> DataFrame:
    """docs with _tie, which tells rows of one id apart."""
    return docs.withColumn("_tie", F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1)))


def _later(found: DataFrame) -> DataFrame:
    """doc_id, tie and line of the windows that occurred before; null ids come last."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "line")
    first = written(found.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    first = first.select(F.col("high").alias("h"), F.col("low").alias("l"), "first", "n")
    return joined(found, first, {"high": "h", "low": "l"}, "n", "tie").where(place > F.col("first")).select("doc_id", "tie", "line")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """doc_id, tie (of the text) and lines, an ordered array of the line numbers to remove, for the rows that lose any."""
    chosen = _tied(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), F.col("text")).select("doc_id", F.col("_tie").alias("tie"), "text")
    per_text = _later(windows(chosen, width)).groupBy("doc_id", "tie").agg(F.collect_set("line").alias("starts"))
    lines = F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x, x + (width - 1)))))
    return per_text.select("doc_id", "tie", F.array_sort(lines).alias("lines"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, removed (line numbers, comma-joined)."""
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    own = _tied(own, F.col("text")).select("doc_id", "_tie", lines.cast("long").alias("n_lines"))
    gone = covered(docs, id_col, text_col, width).select(F.col("doc_id").alias("gone_id"), "tie", "lines")
    return own.join(gone, own.doc_id.eqNullSafe(gone.gone_id) & (own["_tie"] == gone.tie), "left").select("doc_id", "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("lines", ","), F.lit("")).alias("removed"))


def deduplicated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """docs without the covered lines, with all their columns; a text that loses every line is empty."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own, text = (f"c{docs.columns.index(x)}" for x in (id_col, text_col))
    gone = covered(plain, own, text, width)
    both = _tied(plain, F.col(text)).join(gone, F.col(own).eqNullSafe(gone.doc_id) & (F.col("_tie") == gone.tie), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("lines", i)), "\n")
    kept = F.when(F.col("lines").isNull(), F.col(text)).otherwise(left)
    return both.select(*((kept if c == text else F.col(c)).alias(x) for c, x in zip(plain.columns, docs.columns)))
