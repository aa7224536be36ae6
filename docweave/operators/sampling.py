"""Samples of a listing (key, size) by size: bands, quantiles, buckets, variety, and distinct content.

Ranks come from the counts of distinct sizes, summed up, so that no task has
to order the whole listing; only rows of the sizes that matter are looked at
again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as t
from docweave.sources.store import written

KIB = 1024
BANDS = (("small", 0, 100 * KIB), ("medium", 100 * KIB, 512 * KIB), ("large", 512 * KIB, 2048 * KIB), ("xlarge", 2048 * KIB, 20480 * KIB))
QUANTILES = tuple(k / 10 for k in (1, 3, 5, 7, 9))


def listing(lines: DataFrame, suffix: str, line_col: str = "line") -> DataFrame:
    """key, size, last_modified, etag of the files with a suffix, from JSON lines; what doesn't parse is no file."""
    item = F.from_json(line_col, "type string, key string, size long, lastModified string, etag string")
    rows = lines.select(item.alias("i")).select("i.*").where("type = 'file'")
    return rows.where(F.endswith(F.lower("key"), F.lit(suffix))).select("key", F.coalesce("size", F.lit(0)).alias("size"), F.col("lastModified").alias("last_modified"), "etag")


def ranked_sizes(docs: DataFrame, by: list[str], size: str = "size") -> DataFrame:
    """by, size, n, before (rows of smaller size), total."""
    counts = docs.groupBy(*by, size).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(size)
    whole = Window.partitionBy(*by)
    return counts.withColumns({"before": F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(whole)})


def size_distribution(docs: DataFrame, size: str = "size") -> DataFrame:
    """name, size at the nearest rank: minimum, quartiles, ninth decile, maximum; ranks round half to even."""
    ranks = ranked_sizes(docs.withColumn("_all", F.lit(1)), ["_all"], size)
    marks = [("min", 0.0), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("max", 1.0)]
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.bround((F.col("total") - 1) * F.lit(q), 0).cast("long").alias("at")) for n, q in marks)))
    return ranks.select(size, "before", "n", wanted.alias("w")).where("w.at >= before and w.at < before + n").select("w.name", F.col(size).alias("size"))


def band(size: Column) -> Column:
    out = None
    for name, low, high in BANDS:
        fits = (size > low) & (size <= high)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.when(size > BANDS[-1][2], "outlier")


def is_generic(key: Column, names: tuple[str, ...] = ("본문",)) -> Column:
    last = F.element_at(F.split(key, "/"), -1)
    out = F.lit(False)
    for n in names:
        out = out | F.startswith(last, F.lit(n))
    return out


def near_quantiles(docs: DataFrame, quantiles: tuple[float, ...] = QUANTILES, reach: int = 15) -> DataFrame:
    """band, q (from 1), key, size: in each band and near each quantile's rank the first key by generic name, distance of rank, name; none twice.

    Looks at ``reach`` ranks to each side.  The candidates of a band are at
    most ``len(quantiles) * (2 * reach + 1)`` rows, which are picked from in order.
    """
    banded = docs.select("key", "size", band(F.col("size")).alias("band")).where("band is not null and band <> 'outlier'")
    ranks = ranked_sizes(banded, ["band"])
    targets = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), F.bround((F.col("total") - 1) * F.lit(v), 0).cast("long").alias("at")) for i, v in enumerate(quantiles, 1))))
    sizes = ranks.select("band", "size", "before", "n", targets.alias("w")).where(f"before <= w.at + {reach} and before + n > w.at - {reach}").select("band", "size", "before", "w.q", "w.at")
    rows = banded.join(sizes, ["band", "size"])
    place = F.col("before") + F.row_number().over(Window.partitionBy("band", "size", "q").orderBy("key")) - 1
    near = rows.withColumn("rank", place).where(F.abs(F.col("rank") - F.col("at")) <= reach).withColumn("generic", is_generic(F.col("key")))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        out = []
        for q, own in group.groupby("q"):
            own = own.assign(far=(own["rank"] - own["at"]).abs()).sort_values(["generic", "far", "key"])
            free = own[~own["key"].isin(used)]
            if len(free):
                used.add(free.iloc[0]["key"])
                out.append(free.iloc[[0]])
        return pd.concat(out)[["band", "q", "key", "size"]] if out else group.iloc[:0][["band", "q", "key", "size"]]

    return near.select("band", "q", "key", "size", "rank", "at", "generic").groupBy("band").applyInPandas(pick, "band string, q int, key string, size long")


def size_buckets(docs: DataFrame, per_bucket: int) -> DataFrame:
    """bucket, place (from 1), key, size: the smallest, those around the middle, and the largest, per_bucket each.

    The order is by size and key; the middle begins where per_bucket rows fit symmetrically.
    """
    ranks = ranked_sizes(docs.withColumn("_all", F.lit(1)), ["_all"])
    start = F.greatest(F.lit(0), F.floor((F.col("total") - per_bucket) / 2))
    spans = F.explode(F.array(F.struct(F.lit("small").alias("bucket"), F.lit(0).cast("long").alias("a")), F.struct(F.lit("medium").alias("bucket"), start.cast("long").alias("a")), F.struct(F.lit("large").alias("bucket"), (F.col("total") - per_bucket).cast("long").alias("a"))))
    wanted = ranks.where(F.col("total") >= per_bucket).select("size", "before", "n", "total", spans.alias("w")).where(f"before < w.a + {per_bucket} and before + n > w.a").select("size", "before", "total", "w.bucket", "w.a")
    rows = docs.select("key", "size").join(wanted, "size")
    at = F.col("before") + F.row_number().over(Window.partitionBy("bucket", "size").orderBy("key")) - 1
    inside = rows.withColumn("at", at).where(f"at >= a and at < a + {per_bucket}")
    place = F.when(F.col("bucket") == "large", F.col("total") - F.col("at")).otherwise(F.col("at") - F.col("a") + 1)
    return inside.select("bucket", place.alias("place"), "key", "size")


def diversified(docs: DataFrame, order: list[Column], key: str = "key", extension: str = ".hwpx") -> DataFrame:
    """key, pass (1 to 3), pos: the listing in an order of variety.

    First the keys whose folder and family are both new, then those whose
    family is, then the rest; each in the given order.  Going through the keys
    one by one takes a key if no earlier one with its folder or family was
    taken; the same are found in rounds, which take every key that comes first
    in both its folder and its family and drop what shares either.  Only the
    first key of each folder and family takes part.
    """
    spark = docs.sparkSession
    rows = written(docs.select(F.col(key).alias("key"), F.split(key, "/")[0].alias("folder"), t.file_family(F.col(key), extension).alias("family"), F.struct(*order, F.col(key)).alias("o")))
    left = written(rows.groupBy("folder", "family").agg(F.min_by("key", "o").alias("key"), F.min("o").alias("o")))
    taken = spark.createDataFrame([], left.schema)
    while not left.isEmpty():
        ahead = left.join(left.groupBy("folder").agg(F.min("o").alias("of")), "folder").join(left.groupBy("family").agg(F.min("o").alias("oy")), "family")
        now = written(ahead.where("o = of and o = oy").select(*left.columns))
        left = written(left.join(now.select("folder"), "folder", "left_anti").join(now.select("family"), "family", "left_anti"))
        taken = taken.unionByName(now)
    taken = taken.select("key", F.col("family").alias("seen"))
    rest = rows.join(taken.select("key"), "key", "left_anti").join(taken.select(F.col("seen").alias("family")).distinct(), "family", "left_anti")
    second = rest.groupBy("family").agg(F.min_by("key", "o").alias("key")).select("key", F.lit(2).alias("p"))
    passes = rows.join(taken.select("key", F.lit(1).alias("p")).union(second), "key", "left").withColumn("pass", F.coalesce("p", F.lit(3)))
    return numbered(passes.select("key", "pass", "o"), "pass", "o").select("key", "pass", "pos")


def numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with pos, their place from 1 among those of the same ``by`` (of few values), found without bringing these together."""
    placed = written(rows.orderBy(by, *order).withColumn("_at", F.monotonically_increasing_id()))
    begins = sorted(placed.groupBy(by, F.shiftright("_at", 33).alias("part")).agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect(), key=lambda r: (r[0], r["part"]))
    offsets, seen = [], {}
    for r in begins:  # a row for each task of the sort and value
        offsets.append((r[0], r["part"], r["first"] - seen.get(r[0], 0) - 1))
        seen[r[0]] = seen.get(r[0], 0) + r["n"]
    kind = placed.schema[by].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(offsets, f"{by} {kind}, _part long, _base long")
    return placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(table), [by, "_part"]).withColumn("pos", (F.col("_at") - F.col("_base")).cast("int")).drop("_at", "_part", "_base")


def unique_content(samples: DataFrame, per_bucket: int) -> DataFrame:
    """Samples (bucket, place, key, sha256) without content that an earlier one has, the first per_bucket of each bucket; buckets in alphabetical order."""
    first = samples.withColumn("r", F.row_number().over(Window.partitionBy("sha256").orderBy("bucket", "place"))).where("r = 1")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("place"))).where(F.col("n") <= per_bucket).select("bucket", "n", "key", "sha256")
