"""Results that are needed more than once, kept where all executors can read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_noted: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only where the session names none, as in tests on one machine, a
    temporary folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="docweave-"))
    folder = f"{base.rstrip('/')}/docweave-{uuid.uuid4().hex}"
    if _noted:
        _noted[-1].append(folder)
    return folder


@contextmanager
def noted(folders: list[str]) -> Iterator[None]:
    """Adds the folders that are asked for meanwhile to folders, so that they can be dropped once their readers are done."""
    _noted.append(folders)
    try:
        yield
    finally:
        _noted.pop()


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders that shared_folder made, and forgets them."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    folders.clear()


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder once and read from there: later uses don't compute them again, and no lost executor takes them away."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
