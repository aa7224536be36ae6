"""Exact duplicates by an extendible-hash index on shared files.

Texts are keyed by a 64-bit hash of their normalised bytes (A-Z lower-cased).
A directory over the leading bits of the keys says which bucket owns which
range: it begins with one bucket, and while a bucket holds more than its
capacity it is split, the directory doubling whenever the bucket is already
as deep as the directory.  The directory is made from the counts of key
prefixes and has at most 2**max_depth entries, so it is small whatever the
data.

The index lies in the shared folder: a file for each range of buckets, which
rows are inserted into by bucket, sorted by key.  There are as many files as
buckets, up to ``MOST_FILES``.  Each file has one owner task; it walks the
rows by key, chains rows of one key and compares their bytes, so that two
texts of one key stay apart.  Before that, each batch of a scan keeps one row
per text and counts the others, so a text that a third of all rows share
reaches its owner once per batch.

``membership`` looks up each row's group by key, digest and length; groups of
very many rows are broadcast and their rows spread over all tasks.

Null texts are empty texts; all of them are one group.  Of equal texts the
row with the largest id stays, null ids being the smallest.  Rows repeated
with the same id and text are one group like any other; ``deduplicated``
leaves one of them, ``membership`` has a row for each, all marked kept if
theirs is the id that stays.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.group import GroupedData

from docweave.llm._arrow import Texts, column, let_go, slices
from docweave.llm._spark import joined, shared_folder, written


@dataclass(frozen=True)
class Directory:
    """Bucket by the leading ``depth`` bits of a key."""

    depth: int
    buckets: tuple[int, ...]

    @classmethod
    def grown(cls, counts: np.ndarray, capacity: int) -> Directory:
        """From the rows by key prefix; the number of prefixes is a power of two."""
        deepest = int(len(counts)).bit_length() - 1
        total = np.concatenate([[0], np.cumsum(counts)])
        depth, table = 0, [0]
        local = {0: (0, 0)}  # by bucket: its depth and prefix
        pending = [0]
        while pending:
            bucket = pending.pop()
            own, prefix = local[bucket]
            width = 1 << (deepest - own)
            rows = total[(prefix + 1) * width] - total[prefix * width]
            if rows <= capacity or own == deepest:
                continue
            if own == depth:
                table, depth = [b for b in table for _ in range(2)], depth + 1
            other = len(local)
            local[bucket], local[other] = (own + 1, prefix * 2), (own + 1, prefix * 2 + 1)
            span = 1 << (depth - own - 1)
            begin = (prefix * 2 + 1) * span
            table[begin : begin + span] = [other] * span
            pending += [bucket, other]
        return cls(depth, tuple(table))

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(keys), np.int32)
        return np.asarray(self.buckets, np.int32)[keys >> np.uint64(64 - self.depth)]


#: Files of an index; beyond them a file holds several buckets.
MOST_FILES = 1 << 16


def _key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 20240917)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, sha and n (bytes) of the normalised text for docs of doc_id and text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in slices(batches, "text"):
            texts = Texts(column(part, "text"))
            rows = [texts.text(i).lower() for i in range(texts.n)]
            keys = np.array([_key(x) for x in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(keys), pa.array([hashlib.sha256(x).digest() for x in rows], pa.binary()), pa.array(np.diff(texts.offsets))], names=["doc_id", "key", "sha", "n"])

    return docs.mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, sha binary, n long")


def directory(keys: DataFrame, rows: int, capacity: int, max_depth: int) -> Directory:
    """Looks three bits further than evenly filled buckets would need, and max_depth at most."""
    depth = min(max_depth, max(4, (rows // capacity).bit_length() + 3))
    counts = np.zeros(1 << depth, np.int64)
    for prefix, n in keys.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("prefix")).count().collect():
        counts[prefix] = n
    return Directory.grown(counts, capacity)


def _rank(value) -> tuple:
    return (value is not None, value)


def file_marks(spark: SparkSession, files: int) -> np.ndarray:
    """For each of so many files a number that Spark's bucketing puts there and nowhere else; at most MOST_FILES rows."""
    tried = spark.range(int(files * (np.log(files) + 12))).select(F.col("id").cast("int").alias("mark"))
    found = tried.groupBy(F.pmod(F.hash("mark"), F.lit(files)).alias("file")).agg(F.min("mark").alias("mark")).collect()
    return np.array(sorted(r.mark for r in found), np.int32)


def indexed(entries: DataFrame, files: int) -> GroupedData:
    """entries (_key, _bucket, _file, ...) in files of the shared folder, one for each mark, and read from there: by file, the rows by bucket and key."""
    name = f"docweave_{uuid.uuid4().hex}"
    spark = entries.sparkSession
    made = entries.repartition(files, "_file").write.format("parquet").option("path", shared_folder(spark))
    made.bucketBy(files, "_file").sortBy("_bucket", "_key").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return found.sortWithinPartitions("_file", "_bucket", "_key").groupBy("_file")


def winners(docs: DataFrame, index: Directory, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct text: the columns of docs of the row that stays, and _key, _sha and _size of its group."""
    names = docs.columns
    files = min(len(set(index.buckets)), MOST_FILES)
    marks = file_marks(docs.sparkSession, files)
    state = [T.StructField("_key", T.LongType()), T.StructField("_sha", T.BinaryType()), T.StructField("_size", T.LongType())]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 4 << 20):
            texts, ids = Texts(column(part, text_col)), column(part, id_col).to_pylist()
            best: dict[bytes, int] = {}
            sizes = np.zeros(texts.n, np.int64)
            for i in range(texts.n):
                text = texts.text(i).lower()
                j = best.setdefault(text, i)
                if j != i and _rank(ids[i]) > _rank(ids[j]):
                    best[text], sizes[i], j = i, sizes[j], i
                sizes[j] += 1
            at = np.fromiter(best.values(), np.int64, len(best))
            keys = np.fromiter(map(_key, best), np.uint64, len(best))
            rows, bucket = part.take(pa.array(at)), index.of(keys)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys.view(np.int64)), pa.nulls(len(at), pa.binary()), pa.array(sizes[at]), pa.array(bucket), pa.array(marks[bucket % len(marks)])], names=[*names, "_key", "_sha", "_size", "_bucket", "_file"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: int | None = None
        chain: list[list] = []  # text, id, one-row batch, size

        def closed() -> Iterator[pa.RecordBatch]:
            for text, _, row, size in chain:
                yield pa.RecordBatch.from_arrays([*row.columns[: len(names) + 1], pa.array([hashlib.sha256(text).digest()], pa.binary()), pa.array([size], pa.int64())], names=[*names, "_key", "_sha", "_size"])
            chain.clear()

        for part in slices(batches, text_col):
            keys = column(part, "_key").to_numpy()
            sizes, ids, texts = column(part, "_size").to_numpy(), column(part, id_col).to_pylist(), Texts(column(part, text_col))
            bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            lone = bounds[:-1][(np.diff(bounds) == 1) & (sizes[bounds[:-1]] == 1)]
            lone = lone[(keys[lone] != (keys[0] if open_key is None else open_key)) & (keys[lone] != keys[-1])]
            if len(lone):  # no other row of the key: passed on as they are
                rows = part.select([*names, "_key", "_sha", "_size"]).take(pa.array(lone))
                yield pa.RecordBatch.from_arrays(rows.columns, names=rows.schema.names)
            rest = np.ones(len(keys), bool)
            rest[lone] = False
            out: list[pa.RecordBatch] = []
            for i in np.flatnonzero(rest):
                if keys[i] != open_key:
                    out += closed()
                    open_key = keys[i]
                text = texts.text(i).lower()
                for entry in chain:
                    if entry[0] == text:
                        entry[3] += int(sizes[i])
                        if _rank(ids[i]) > _rank(entry[1]):
                            entry[1], entry[2] = ids[i], part.slice(i, 1)
                        break
                else:
                    chain.append([text, ids[i], part.slice(i, 1), int(sizes[i])])
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            for entry in chain:  # lets go of the batch that the row came in
                entry[2] = entry[2].take(pa.array([0]))
        yield from closed()

    schema = T.StructType([*docs.schema.fields, *state])
    partial = docs.mapInArrow(combine, T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType()), T.StructField("_file", T.IntegerType())]))
    return indexed(partial, files).applyInArrow(own, schema)


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 16_384, max_depth: int = 18) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    keys = written(keyed(chosen))
    groups = winners(chosen, directory(keys, keys.count(), capacity, max_depth), "doc_id", "text").where("_size > 1")
    groups = written(groups.select(F.col("doc_id").alias("_keep"), "_key", "_sha", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("_n"), "_size"))
    found = joined(keys, groups, {"key": "_key", "sha": "_sha", "n": "_n"}, "_size", "doc_id")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 16_384, max_depth: int = 18) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own, text = (f"c{docs.columns.index(x)}" for x in (id_col, text_col))
    keys = written(keyed(plain.select(F.col(own).alias("doc_id"), F.col(text).alias("text"))).select("key"))
    return winners(plain, directory(keys, keys.count(), capacity, max_depth), own, text).select(*(F.col(c).alias(x) for c, x in zip(plain.columns, docs.columns)))
