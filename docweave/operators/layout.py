"""Page geometry: boxes as (x0, top, x1, bottom).

The functions work on one page's lists, for the reader; the DataFrame
versions are the same rules over tables of boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def inside(a: Box, b: Box, tolerance: float = 2.0) -> bool:
    return a[0] >= b[0] - tolerance and a[1] >= b[1] - tolerance and a[2] <= b[2] + tolerance and a[3] <= b[3] + tolerance


def alike(a: Box, b: Box, margin: float = 3.0) -> bool:
    return all(abs(x - y) <= margin for x, y in zip(a, b))


def area(b: Box) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def crossing(a: Box, b: Box) -> bool:
    return a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]


def smallest_around(b: Box, cells: list[tuple], tolerance: float) -> tuple | None:
    """Of cells (key, box), the key of the smallest that b lies in; the first of equals."""
    fits = [(area(c), i) for i, (_, c) in enumerate(cells) if inside(b, c, tolerance)]
    return cells[min(fits)[1]][0] if fits else None


def positions(values: list[float], tolerance: float = 2.0) -> list[float]:
    """Positions that nearly coincide as one, which moves to the middle of each new pair."""
    out: list[float] = []
    for v in sorted(values):
        if out and v - out[-1] <= tolerance:
            out[-1] = (out[-1] + v) / 2
        else:
            out.append(v)
    return out


def gaps(bands: list[tuple[float, float]], height: float, least: float = 2.0) -> list[tuple[float, float]]:
    """What obstacle bands (top, bottom) leave free of a page, from top to bottom."""
    out, at = [], 0.0
    for top, bottom in sorted(bands, key=lambda b: b[0]):
        if top > at + least:
            out.append((at, top))
        at = max(at, bottom)
    return [*out, (at, height)] if height and at < height - least else out


def vertical_clusters(boxes: list[tuple], gap: float = 30.0) -> list[list[tuple]]:
    """Boxes (x0, top, x1, bottom, ...) that follow each other downwards without a larger gap."""
    out: list[list[tuple]] = []
    bottom = 0.0
    for b in sorted(boxes, key=lambda b: b[1]):
        if out and b[1] - bottom <= gap:
            out[-1].append(b)
            bottom = max(bottom, b[3])
        else:
            out.append([b])
            bottom = b[3]
    return out


# Over tables of boxes


def free_bands(bands: DataFrame, pages: DataFrame, least: float = 2.0) -> DataFrame:
    """page, top, bottom of the free bands; bands (page, top, bottom), pages (page, height)."""
    w = Window.partitionBy("page").orderBy("top", "bottom")
    before = F.coalesce(F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    between = bands.select("page", before.alias("a"), F.col("top").alias("z"))
    last = pages.join(bands.groupBy("page").agg(F.max("bottom").alias("end")), "page", "left").select("page", F.coalesce("end", F.lit(0.0)).alias("a"), F.col("height").alias("z"))
    return between.union(last).where(F.col("z") > F.col("a") + least).select("page", F.col("a").alias("top"), F.col("z").alias("bottom"))


def clusters(boxes: DataFrame, gap: float = 30.0) -> DataFrame:
    """boxes (page, box, x0, top, x1, bottom) with cluster, numbered from the top of each page."""
    w = Window.partitionBy("page").orderBy("top", "box")
    reach = F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = boxes.withColumn("_fresh", F.coalesce((F.col("top") - reach > gap).cast("int"), F.lit(0)))
    return fresh.withColumn("cluster", F.sum("_fresh").over(w)).drop("_fresh")


def containing(inner: DataFrame, cells: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """page, item, cell: for each item the smallest cell of its page around it, the first of equals; nothing for items in none.

    A page is the join key: what meets is an item and the cells of its page.
    """
    i, c = inner.alias("i"), cells.alias("c")
    fits = (F.col("i.x0") >= F.col("c.x0") - tolerance) & (F.col("i.x1") <= F.col("c.x1") + tolerance) & (F.col("i.top") >= F.col("c.top") - tolerance) & (F.col("i.bottom") <= F.col("c.bottom") + tolerance)
    size = (F.col("c.x1") - F.col("c.x0")) * (F.col("c.bottom") - F.col("c.top"))
    joined = i.join(c, (F.col("i.page") == F.col("c.page")) & fits)
    return joined.groupBy(F.col("i.page").alias("page"), F.col("i.item").alias("item")).agg(F.min_by("c.cell", F.struct(size, "c.cell")).alias("cell"))


def without_native(read: DataFrame, native: DataFrame) -> DataFrame:
    """Texts read from pictures (doc_id, n, text) that no text of the document itself (doc_id, text) contains, white space aside."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    own = native.select("doc_id", bare(F.col("text")).alias("native")).where("native <> ''")
    made = read.withColumn("bare", bare(F.col("text"))).where("bare <> ''")
    return made.alias("r").join(own.alias("o"), (F.col("r.doc_id") == F.col("o.doc_id")) & F.contains("o.native", F.col("r.bare")), "left_anti").drop("bare")
