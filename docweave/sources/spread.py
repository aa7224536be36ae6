"""Work for all cores when the input lies in few partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer; with key always, the rows of a key together.

    A small file is one partition, however much Python it costs to read it.
    Inputs of more partitions than cores stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if key:
        return df.repartition(max(cores, df.rdd.getNumPartitions()), key)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def tasks(df: DataFrame) -> int:
    """As many as the files that df reads have partitions, and spark.sql.shuffle.partitions at least.

    The scans are asked, not df: its own number of partitions is known only
    once all its shuffles have run, which then run again for the result.
    """
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    read = sum(leaves.apply(i).execute().getNumPartitions() for i in range(leaves.size()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), read)


def by_document(df: DataFrame, *order: str, key: str = "doc_id") -> DataFrame:
    """Each document's rows together and in order, in as many tasks as df's files have partitions and spark.sql.shuffle.partitions at least: few bytes can be much work, so they are not merged."""
    return df.repartition(tasks(df), key).sortWithinPartitions(key, *order)
