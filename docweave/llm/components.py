"""Connected components of a graph given by its links.

Links are first contracted within each task by union-find, which leaves a
star per component and task.  If at most ``FEW`` links are left by then, one
task contracts these as well.  Otherwise large-star and small-star steps
alternate over the whole graph until nothing changes: the first ties every
larger neighbour of a node to the least of its neighbours, the second ties
the smaller ones.  Minima are aggregated before they are joined back; nodes
of very many links are broadcast there and their links spread over all tasks,
so no task holds the neighbours of a node together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._arrow import column
from docweave.llm._spark import joined, written


#: Links that one task can contract in memory.
FEW = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch], limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def out() -> Iterator[pa.RecordBatch]:
        pairs = [(x, find(x)) for x in list(root)]
        pairs = [p for p in pairs if p[0] != p[1]]
        root.clear()
        if pairs:
            a, b = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > limit:
            yield from out()
    yield from out()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b of type long); root is the least node of its component."""
    edges = written(links.select("a", "b").mapInArrow(_stars, "a long, b long"))
    before = _state(edges)
    if before[0] <= FEW:
        edges = written(edges.coalesce(1).mapInArrow(partial(_stars, limit=2 * FEW), "a long, b long"))
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"), "n"))
        large = joined(both.where("b > a"), least, {"a": "u"}, "n", "b").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tops = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), "m", "n"))
        small = joined(large, tops, {"a": "u"}, "n", "b").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(tops.select("u", "m")).distinct())
        now = _state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before = now
