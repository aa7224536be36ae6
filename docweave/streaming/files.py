"""A stream of files to evidence and chunks.

Reading is stateless, so a micro-batch is read as a batch is; chunking needs
a document's units together, which a micro-batch has, as a file arrives
whole.  Each micro-batch replaces its own folder, so one that is repeated
after a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.operators import chunking, enrichment
from docweave.sources import evidence
from docweave.sources.evidence import Reader
from docweave.sources.registry import default_readers


def documents(files: DataFrame) -> DataFrame:
    """doc_id (a hash of the path), suffix, content of binary files."""
    name = F.lower(F.regexp_extract("path", r"((?:\.pages)?\.[^./]+)$", 1))
    return files.select(F.xxhash64("path").alias("doc_id"), name.alias("suffix"), "content")


def arriving(spark: SparkSession, folder: str, most: int = 1_000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most).load(folder)


def evidence_stream(spark: SparkSession, folder: str, readers: Mapping[str, Reader] | None = None) -> DataFrame:
    return evidence.read(documents(arriving(spark, folder)), readers or default_readers())


def index_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, limits: chunking.Limits = chunking.Limits(), once: bool = False) -> StreamingQuery:
    """Writes enriched chunks of the files in folder below out, a folder per micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        enrichment.enrich(chunking.chunks(evidence.units(batch), limits)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = evidence_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
