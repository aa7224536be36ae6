"""Documents made from the relational tables, so that what a reader finds can be checked against SQL over those tables."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.sources import compound, evidence, hwp5
from docweave.sources.spread import spread, tasks


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark, sf_dir: str) -> DataFrame:
    """Sixteen parts or fewer to a group: n_regionkey (of the group), n_nationkey, n_name.

    Groups are spread over all cores: a document of few bytes is much work, and
    tasks would be merged for their bytes.
    """
    return spread(table(spark, sf_dir, "part").selectExpr("cast(p_partkey div 16 as int) AS n_regionkey", "p_partkey AS n_nationkey", "concat(p_name, ' ', p_brand) AS n_name"), "n_regionkey")


def groups(spark, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).select(F.col("n_regionkey").alias("r_regionkey"), F.concat(F.lit("Group "), "n_regionkey").alias("r_name")).distinct()


#: The same for SQL.
MEMBERS = "(SELECT (p_partkey // 16)::INT AS n_regionkey, p_partkey AS n_nationkey, p_name || ' ' || p_brand AS n_name FROM part)"
GROUPS = "(SELECT DISTINCT (p_partkey // 16)::INT AS r_regionkey, 'Group ' || p_partkey // 16 AS r_name FROM part)"


def grouped_sql(sql: str) -> str:
    """sql about nation and region, put to members and groups."""
    return re.sub(r"\bregion\b(?! AS)", GROUPS, re.sub(r"\bnation\b(?! AS)", MEMBERS, sql))


def joined(c: str, order: str):
    """The values of a group in order, one after the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.expr(c).alias("v")))), lambda x: x["v"]), "")


def order_pages(spark, sf_dir: str) -> DataFrame:
    """A page per order: its key as heading, its lines as a table.

    The lines are brought together once, narrow as they are, in tasks that are
    not merged for their few bytes; the pages stay where they are made.
    """
    row = "concat('<tr><td>', l_linenumber, '</td><td>', l_partkey, '</td><td>', cast(l_quantity as int), '</td><td>', l_returnflag, '</td></tr>')"
    read = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    lines = read.repartition(tasks(read), "l_orderkey").groupBy("l_orderkey").agg(joined(row, "l_linenumber").alias("rows"))
    html = F.concat(F.lit("<html><body><main><h1>Order "), F.col("l_orderkey"), F.lit("</h1><table><caption>Lines</caption><tr><th>line</th><th>part</th><th>quantity</th><th>flag</th></tr>"), F.col("rows"), F.lit("</table></main></body></html>"))
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(".html").alias("suffix"), html.alias("content"))


def region_page(spark, sf_dir: str) -> DataFrame:
    """A page per group: its cell spans the rows of its members."""
    both = members(spark, sf_dir).join(groups(spark, sf_dir), F.col("n_regionkey") == F.col("r_regionkey"))
    ranked = both.selectExpr("*", "row_number() over (partition by r_regionkey order by n_nationkey) as k", "count(*) over (partition by r_regionkey) as n")
    row = "concat('<tr>', case when k = 1 then concat('<td rowspan=\"', n, '\">', r_name, '</td>') else '' end, '<td>', n_name, '</td></tr>')"
    html = ranked.groupBy(F.col("r_regionkey").cast("long").alias("doc_id")).agg(joined(row, "k").alias("rows"))
    return html.select("doc_id", F.lit(".html").alias("suffix"), F.concat(F.lit("<table><tr><th>region</th><th>nation</th></tr>"), "rows", F.lit("</table>")).alias("content"))


def nested_pages(spark, sf_dir: str) -> DataFrame:
    """A page per region: a cell that holds a table of its nations."""
    inner = members(spark, sf_dir).groupBy("n_regionkey").agg(joined("concat('<tr><td>', n_nationkey, '</td><td>', n_name, '</td></tr>')", "n_nationkey").alias("rows"))
    both = groups(spark, sf_dir).join(inner, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    html = F.concat(F.lit("<table><tr><th>region</th><th>nations</th></tr><tr><td>"), "r_name", F.lit("</td><td>in it<table><tr><th>key</th><th>name</th></tr>"), F.coalesce("rows", F.lit("")), F.lit("</table></td></tr></table>"))
    return both.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit(".htm").alias("suffix"), html.alias("content"))


def image_pages(spark, sf_dir: str) -> DataFrame:
    """A page per part with one image: its name in base64, broken base64, another type, or elsewhere."""
    data = F.base64(F.encode("p_name", "UTF-8"))
    source = F.element_at(F.array(F.concat(F.lit("data:image/png;base64,"), data), F.lit("data:image/png;base64,?"), F.concat(F.lit("data:image/svg+xml;base64,"), data), F.lit("https://elsewhere.example/x.png")), (F.col("p_partkey") % 4 + 1).cast("int"))
    html = F.concat(F.lit('<figure><img src="'), source, F.lit('" alt="part"><figcaption>'), "p_type", F.lit("</figcaption></figure>"))
    return spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("doc_id"), F.lit("html").alias("suffix"), html.alias("content"))


def _made(rows: DataFrame, suffix: str, build: Callable[[dict], bytes]) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("suffix", pa.string()), ("content", pa.binary())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return evidence.in_batches(({"doc_id": r["doc_id"], "suffix": suffix, "content": build(r)} for r in evidence.rows_in(batches)), schema)

    return rows.mapInArrow(apply, "doc_id long, suffix string, content binary")


def _nations(spark, sf_dir: str) -> DataFrame:
    each = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    rows = members(spark, sf_dir).groupBy("n_regionkey").agg(each.alias("nations"))
    return rows.join(groups(spark, sf_dir), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").cast("long").alias("doc_id"), "r_name", "nations")


def hwpx_regions(spark, sf_dir: str) -> DataFrame:
    """An archive per region: a paragraph with its name, a table of its nations."""

    def build(r: dict) -> bytes:
        p = lambda x: f"<p><run><t>{x}</t></run></p>"
        cell = lambda x: f"<tc><subList>{p(x)}</subList></tc>"
        rows = [("key", "name"), *((n["n_nationkey"], n["n_name"]) for n in r["nations"])]
        body = "".join(f"<tr>{cell(a)}{cell(b)}</tr>" for a, b in rows)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("Contents/section0.xml", f'<sec xmlns="http://www.hancom.co.kr/hwpml/2011/paragraph">{p(r["r_name"])}<p><run><tbl>{body}</tbl></run></p></sec>')
        return out.getvalue()

    return _made(_nations(spark, sf_dir), ".hwpx", build)


def hwp5_regions(spark, sf_dir: str) -> DataFrame:
    """The same as records in a compressed compound file."""

    def build(r: dict) -> bytes:
        said = lambda x, level: hwp5.packed(hwp5.PARA_TEXT, level, str(x).encode("utf-16-le"))
        rows = [("key", "name"), *((n["n_nationkey"], n["n_name"]) for n in r["nations"])]
        parts = [said(r["r_name"], 1), hwp5.packed(hwp5.CONTROL, 1, b" lbt"), hwp5.packed(hwp5.TABLE, 2, b"\0" * 4 + struct.pack("<HH", len(rows), 2))]
        for i, row in enumerate(rows):
            for j, x in enumerate(row):
                parts += [hwp5.packed(hwp5.LIST, 2, b"\0" * 8 + struct.pack("<HHHH", j, i, 1, 1)), said(x, 3)]
        press = zlib.compressobj(9, zlib.DEFLATED, -15)
        section = press.compress(b"".join(parts)) + press.flush()
        return compound.build({"FileHeader": b"HWP Document File".ljust(36, b"\0") + struct.pack("<I", 1), "BodyText/Section0": section})

    return _made(_nations(spark, sf_dir), ".hwp", build)


def layout_regions(spark, sf_dir: str) -> DataFrame:
    """The same as page primitives, the table cut over two pages."""

    def build(r: dict) -> bytes:
        rows = [[str(n["n_nationkey"]), n["n_name"]] for n in r["nations"]]
        half = (len(rows) + 1) // 2

        def page(body: list, text: str) -> dict:
            every = [["key", "name"], *body]
            chars = [{"text": c, "x0": 50 + 6 * i, "x1": 55 + 6 * i, "top": 40, "bottom": 50} for i, c in enumerate(text)]
            cells = [{"cells": [[50, 100 + 20 * i, 150, 120 + 20 * i], [150, 100 + 20 * i, 400, 120 + 20 * i]], "texts": x} for i, x in enumerate(every)]
            return {"width": 600, "height": 800, "chars": chars, "tables": [{"bbox": [50, 100, 400, 100 + 20 * len(every)], "rows": cells}]}

        return json.dumps({"pages": [page(rows[:half], r["r_name"]), page(rows[half:], "")]}).encode()

    return _made(_nations(spark, sf_dir), ".pages.json", build)
