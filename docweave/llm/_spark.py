"""What the operators need of the session."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.spread import spread
from docweave.sources.store import shared_folder, written

__all__ = ["documents", "joined", "shared_folder", "small", "written"]


def small(table: DataFrame, rows: int = 20_000) -> DataFrame:
    """table, to be broadcast if it is known to have no more than so many rows (of a few numbers and a short name each); else joins on it shuffle.

    table should be written, as it is counted first.
    """
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def joined(rows: DataFrame, groups: DataFrame, on: dict[str, str], size: str, salt: str, least: int = 10_000, most: int = 1 << 16) -> DataFrame:
    """rows, left-joined with the one row of groups for each key; on maps columns of rows to those of groups.

    size is the column of groups with the number of rows that have the key.
    The groups of more than least rows, and of more than a share of 1 / most
    of all that groups counts, are therefore at most ``most`` rows: they are
    broadcast, and their rows are spread by the column salt instead of
    meeting in one task.  groups should be written, as it is read twice.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    bound = max(least, total // most)
    keys = list(on.items())
    heavy = groups.where(F.col(size) > bound).select(*(F.col(g).alias(f"_h{i}") for i, (_, g) in enumerate(keys)), F.struct(*groups.columns).alias("_heavy"))
    light = groups.where(F.col(size) <= bound).select(*(F.col(g).alias(f"_l{i}") for i, (_, g) in enumerate(keys)), F.struct(*groups.columns).alias("_light"))
    if total > bound:
        at = rows.join(F.broadcast(heavy), reduce(and_, (F.col(r).eqNullSafe(F.col(f"_h{i}")) for i, (r, _) in enumerate(keys))), "left")
    else:
        at = rows.withColumn("_heavy", F.lit(None).cast(heavy.schema["_heavy"].dataType))
    at = at.withColumn("_salt", F.when(F.col("_heavy").isNotNull(), F.xxhash64(salt)).otherwise(F.lit(0).cast("long")))
    light = light.withColumn("_l_salt", F.lit(0).cast("long"))
    met = at.join(light, reduce(and_, (F.col(r).eqNullSafe(F.col(f"_l{i}")) for i, (r, _) in enumerate(keys))) & (F.col("_salt") == F.col("_l_salt")), "left")
    found = F.coalesce("_heavy", "_light")
    return met.select(*rows.columns, *(found[c].alias(c) for c in groups.columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
