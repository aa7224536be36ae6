"""Assets: written out once, and resolved where units refer to them."""

from __future__ import annotations

import hashlib
import hmac
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.sources.evidence import dumped, sliced

Put = Callable[[str, bytes, str], str]


def folder_sink(root: str) -> Put:
    """Writes below a folder that all executors see, by a path or a URI that pyarrow knows; returns the file's URI.

    Writing a key again replaces it, so a repeated task changes nothing.
    """

    def put(key: str, data: bytes, mime: str) -> str:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        path = f"{base.rstrip('/')}/{key}"
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(path) as out:
            out.write(data)
        return f"{root.rstrip('/')}/{key}"

    return put


def signature(secret: str, region: str, when: str, request: str) -> tuple[str, str]:
    """Scope and signature (version 4, for an object store) of a canonical request at a time like 20200131T235959Z."""
    scope = [when[:8], region, "s3", "aws4_request"]
    told = "\n".join(["AWS4-HMAC-SHA256", when, "/".join(scope), hashlib.sha256(request.encode()).hexdigest()])
    key = reduce(lambda k, part: hmac.digest(k, part.encode(), "sha256"), [*scope, told], f"AWS4{secret}".encode())
    return "/".join(scope), key.hex()


def signed_sink(endpoint: str, bucket: str, access_key: str, secret_key: str, prefix: str = "", region: str = "us-east-1", send: Callable[[urllib.request.Request], int] | None = None, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> Put:
    """Writes to an object store behind a signed HTTP endpoint; returns s3://bucket/key.

    Writing a key again replaces it.  send takes a request and returns the status; the default goes over HTTP.
    """

    def put(key: str, data: bytes, mime: str) -> str:
        name = "/".join(x for x in (prefix.strip("/"), key) if x)
        path = urllib.parse.quote(f"/{bucket}/{name}")
        when = now().strftime("%Y%m%dT%H%M%SZ")
        headers = {"content-type": mime, "host": urllib.parse.urlsplit(endpoint).netloc, "x-amz-content-sha256": hashlib.sha256(data).hexdigest(), "x-amz-date": when}
        names = ";".join(headers)  # in alphabetical order
        request = "\n".join(["PUT", path, "", *(f"{k}:{v}" for k, v in headers.items()), "", names, headers["x-amz-content-sha256"]])
        scope, signed = signature(secret_key, region, when, request)
        headers["authorization"] = f"AWS4-HMAC-SHA256 Credential={access_key}/{scope}, SignedHeaders={names}, Signature={signed}"
        status = (send or _over_http)(urllib.request.Request(endpoint.rstrip("/") + path, data, headers, method="PUT"))
        if status not in (200, 201, 204):
            raise OSError(f"putting {name!r} failed with status {status}")
        return f"s3://{bucket}/{name}"

    return put


def _over_http(request: urllib.request.Request) -> int:
    with urllib.request.urlopen(request, timeout=120) as response:
        return response.status


STORED = "doc_id long, id string, kind string, uri string, mime string, ext string, sha256 string, bytes long, metadata string"


def stored(assets: DataFrame, documents: DataFrame, put: Put) -> DataFrame:
    """The assets (of ``evidence.assets``) put under ``<sha256 of the document>/assets/<id>.<ext>``, with their URIs.

    documents has doc_id and sha256.  A failure to put one fails the job.
    """
    names = [x.split()[0] for x in STORED.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for r in batch.to_pylist():
                ext = (r["ext"] or "").lstrip(".") or "bin"
                uri = put(f"{r['sha256']}/assets/{r['id']}.{ext}", r["data"], r["mime"])
                rows.append((r["doc_id"], r["id"], r["type"], uri, r["mime"], ext, hashlib.sha256(r["data"]).hexdigest(), len(r["data"]), r["metadata"]))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("doc_id", "bytes") else pa.string()) for n, c in zip(names, columns)], names=names)

    owned = assets.join(documents.select("doc_id", "sha256"), "doc_id").select("doc_id", "id", "type", "mime", "ext", "data", "metadata", "sha256")
    return owned.mapInArrow(apply, STORED)


class UnknownAsset(ValueError):
    pass


def resolve(value: Any, known: dict[str, dict]) -> Any:
    """value with every asset reference in it filled in; nested children keep type, format and content only."""
    if isinstance(value, list):
        return [resolve(x, known) for x in value]
    if not isinstance(value, dict):
        return value
    if "format" in value and "content" in value and ("type" in value or "kind" in value):
        content = value["content"]
        if value["format"] == "asset_ref":
            name = content.get("asset_id")
            if name not in known:
                raise UnknownAsset(f"no asset {name!r}")
            return {"type": value.get("type", value.get("kind")), "format": "asset_ref", "content": {**content, **known[name]}}
        return {"type": value.get("type", value.get("kind")), "format": value["format"], "content": resolve(content, known)}
    return {k: resolve(v, known) for k, v in value.items()}


def resolved(units: DataFrame, stored_assets: DataFrame) -> DataFrame:
    """units whose content has the URI, type, size and hash of each asset it refers to, however deep; a reference to nothing fails the job."""
    facts = F.struct("id", "uri", "mime", "ext", "sha256", "bytes")
    per_doc = stored_assets.groupBy("doc_id").agg(F.collect_list(facts).alias("known"))
    joined = units.join(per_doc, "doc_id", "left")
    names, schema = units.columns, units.schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for r in batch.select(["type", "format", "content", "known"]).to_pylist():
                if r["format"] == "plain":
                    out.append(r["content"])
                    continue
                known = {x.pop("id"): x for x in r["known"] or []}
                whole = resolve({"type": r["type"], "format": r["format"], "content": json.loads(r["content"])}, known)
                out.append(dumped(whole["content"]))
            arrays = [pa.array(out, pa.string()) if n == "content" else batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.select(*names, "known").mapInArrow(apply, schema)


def orphans(references: DataFrame, known: DataFrame) -> DataFrame:
    """References (doc_id, asset_id) to assets that are not known (doc_id, id)."""
    return references.join(known.select("doc_id", F.col("id").alias("asset_id")), ["doc_id", "asset_id"], "left_anti")
