"""Reading a corpus whatever its documents do: each has a status, a time, and what was found in it."""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.sources.compound import MAGIC
from docweave.sources.evidence import Parsed, Reader, sliced

STATUS = "doc_id long, status string, error string, bytes long, elapsed_seconds double, n_units int, n_assets int, n_warnings int, asset_refs int, unit_types string"


class TooLong(Exception):
    pass


@contextmanager
def limited(seconds: float) -> Iterator[None]:
    """Raises TooLong after some seconds, where signals can be used; else does nothing."""
    if seconds <= 0 or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_) -> None:
        raise TooLong

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def asset_refs(value) -> int:
    """How many references to assets a tree has."""
    if isinstance(value, list):
        return sum(map(asset_refs, value))
    return (value.get("format") == "asset_ref") + sum(map(asset_refs, value.values())) if isinstance(value, dict) else 0


def scan(docs: DataFrame, readers: Mapping[str, Reader], seconds: float = 240.0) -> DataFrame:
    """One row per document (doc_id, suffix, content): ok, timeout, parse_error, or skipped where the bytes are not what the suffix says."""
    known, names = dict(readers), [x.split()[0] for x in STATUS.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    schema = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, STATUS.split(", "))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for doc_id, suffix, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = content.encode() if isinstance(content, str) else content or b""
                parsed, status, error, began = Parsed(), "ok", None, time.monotonic()
                if suffix == ".hwp" and not data.startswith(MAGIC):
                    status = "skipped"
                else:
                    try:
                        with limited(seconds):
                            parsed = known[suffix](data)
                    except TooLong:
                        status = "timeout"
                    except Exception as problem:  # a document that can't be read is a row, not a failed job
                        status, error = "parse_error", f"{type(problem).__name__}: {problem}"[:500]
                kinds = sorted({u["type"] for u in parsed.units})
                out.append((doc_id, status, error, len(data), round(time.monotonic() - began, 3), len(parsed.units), len(parsed.assets), len(parsed.warnings), asset_refs(parsed.units), ",".join(kinds)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(names), schema)], schema=schema)

    return docs.select("doc_id", "suffix", "content").mapInArrow(apply, STATUS)


__all__ = ["STATUS", "asset_refs", "limited", "scan"]
