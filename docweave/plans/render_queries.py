"""Inspection pages, JSON, status of a scan, and the stream over files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.operators import assets, enrichment, passes, profiles, rendering, scan
from docweave.plans import synthetic
from docweave.plans.parse_queries import _ORDER_ROWS
from docweave.sources import evidence
from docweave.sources.registry import default_readers


def unit_pages(spark, sf_dir):
    html = F.col("html")
    return passes.unit_pages(synthetic.order_pages(spark, sf_dir), default_readers()).select("doc_id", F.regexp_count(html, F.lit("<tr>")).cast("long").alias("rows"), F.regexp_count(html, F.lit("<td>")).cast("long").alias("cells"), _body(html))


def _body(html) -> Column:
    """The MD5 of what a page shows."""
    return F.md5(F.regexp_extract(html, "(?s)<main>(.*)</main>", 1)).alias("body_md5")


def span_pages(spark, sf_dir):
    """Cells that span rows, as HTML."""
    pages = passes.unit_pages(synthetic.region_page(spark, sf_dir), default_readers())
    return pages.select("doc_id", _body(F.col("html")))


def figure_pages(spark, sf_dir):
    """Resolved images, as HTML."""
    docs = synthetic.image_pages(spark, sf_dir)
    found = evidence.read(docs, default_readers())
    named = docs.select("doc_id", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"))
    kept = assets.stored(evidence.assets(found), named, lambda key, data, mime: f"s3://evidence/{key[65:]}")
    return rendering.unit_pages(assets.resolved(evidence.units(found), kept)).select("doc_id", _body(F.col("html")))


def chunk_pages(spark, sf_dir):
    pages = passes.chunk_pages(synthetic.order_pages(spark, sf_dir), default_readers(), enrich=enrichment.enriched)
    return pages.select("doc_id", F.regexp_count("html", F.lit('class="chunk"')).cast("long").alias("chunks"), F.regexp_count("html", F.lit("<td>")).cast("long").alias("cells"), F.md5(F.regexp_extract("html", "(?s)</details>(.*)</section></main>", 1)).alias("body_md5"))


def evidence_json(spark, sf_dir):
    made = passes.evidence_json(synthetic.order_pages(spark, sf_dir), default_readers()).select("doc_id", F.from_json("json", "array<struct<id:string,type:string,content:struct<rows:array<struct<index:int>>>>>").alias("j"))
    return made.select("doc_id", F.size("j").alias("units"), F.size(F.col("j")[0]["content"]["rows"]).alias("rows"))


def scan_status(spark, sf_dir):
    """Good and broken documents side by side: each has its status, and the job goes on."""
    made = synthetic.hwpx_regions(spark, sf_dir).union(synthetic.hwp5_regions(spark, sf_dir).selectExpr("doc_id + 100000000", "suffix", "content"))
    broken = made.select((F.col("doc_id") + 1000000000).alias("doc_id"), "suffix", F.substring("content", 10, 100).alias("content"))
    return scan.scan(made.union(broken), default_readers()).select("doc_id", "status", "n_units", "unit_types")


def diagram_profiles(spark, sf_dir):
    """Drawings with a box per nation of a region and a line between neighbours."""

    def build(r: dict) -> bytes:
        import io
        import zipfile

        n = r["nations"]
        boxes = "".join(f'<rect x="{100 * i}" y="0" width="50" height="20"><t>{x["n_name"]}</t></rect>' for i, x in enumerate(n))
        lines = "".join(f'<line x="{100 * i + 50}" y="10" width="50" height="0" tailArrow="1"/>' for i in range(len(n) - 1))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("Contents/section0.xml", f'<sec xmlns="http://www.hancom.co.kr/hwpml/2011/paragraph"><p><run>{boxes}{lines}</run></p></sec>')
        return out.getvalue()

    found = profiles.diagram_profiles(evidence.units(evidence.read(synthetic._nations(spark, sf_dir), default_readers(), (".hwpx", build))))
    return found.select("doc_id", "nodes", "bbox_nodes", "connectors", "edges", "labeled_edges", "source_relation_lines", "bbox_node_ratio", "score", "flags")


def table_outliers(spark, sf_dir):
    """Tables by score, wide ones flagged: a table per order status of all priorities and customers' segments."""
    orders = synthetic.table(spark, sf_dir, "orders").join(synthetic.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.groupBy((F.col("o_orderkey") % 20).alias("doc_id"), "c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))
    row = "concat('<tr><td>', c_mktsegment, '</td><td>', o_orderpriority, '</td><td>', n, '</td><td></td>', repeat('<td></td>', 56), '</tr>')"
    docs = rows.withColumn("at", F.concat("c_mktsegment", "o_orderpriority")).groupBy("doc_id").agg(synthetic.joined(row, "at").alias("rows"))
    html = docs.select("doc_id", F.lit(".html").alias("suffix"), F.concat(F.lit("<table><tr>"), F.repeat(F.lit("<th>h</th>"), F.lit(60)), F.lit("</tr>"), "rows", F.lit("</table>")).alias("content"))
    found = profiles.outliers(profiles.table_profiles(evidence.units(evidence.read(html, default_readers()))))
    return found.select("doc_id", "rank", "columns", "cells", "blank_cells", "score", "flags")


QUERIES = {f.__name__: f for f in (unit_pages, chunk_pages, span_pages, figure_pages, evidence_json, scan_status, diagram_profiles, table_outliers)}

_ORDER_PAGES = f"""WITH r AS ({_ORDER_ROWS}), o AS (SELECT doc_id, count(*) AS n, 'section: Order ' || doc_id || chr(10) || 'caption: Lines' || chr(10) || 'columns: line | part | quantity | flag' || chr(10) ||
        string_agg('row ' || row_index || ': line=' || l_linenumber || '; part=' || l_partkey || '; quantity=' || l_quantity::INT || '; flag=' || l_returnflag, chr(10) ORDER BY row_index) AS said,
        '<table class="evidence-table"><caption>Lines</caption><thead><tr><th>line</th><th>part</th><th>quantity</th><th>flag</th></tr></thead><tbody>' ||
        string_agg('<tr><td>' || l_linenumber || '</td><td>' || l_partkey || '</td><td>' || l_quantity::INT || '</td><td>' || l_returnflag || '</td></tr>', '' ORDER BY row_index) || '</tbody></table>' AS html FROM r GROUP BY doc_id)"""
ORACLES = {
    "unit_pages": f"""{_ORDER_PAGES} SELECT doc_id, n + 1 AS "rows", 4 * n AS cells, md5('<h1>Evidence units</h1><section class="unit"><header><code>b1</code> table</header><pre>' || said || '</pre>' || html || '</section>') AS body_md5 FROM o""",
    "chunk_pages": f"""{_ORDER_PAGES} SELECT doc_id, 1::BIGINT AS chunks, 4 * n AS cells, md5('<p class="diagnostic">fallback: chunk plan must be a list</p><pre>' || said || '</pre><div class="evidence-item">' || html || '</div>') AS body_md5 FROM o""",
    "span_pages": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY n_regionkey) AS n FROM {synthetic.MEMBERS} JOIN {synthetic.GROUPS} ON n_regionkey = r_regionkey)
        SELECT n_regionkey::BIGINT AS doc_id, md5('<h1>Evidence units</h1><section class="unit"><header><code>b1</code> table</header><pre>columns: region | nation' || chr(10) || string_agg('row ' || k || ': ' || CASE WHEN k = 1 THEN 'region=' || r_name || '; ' ELSE '' END || 'nation=' || n_name, chr(10) ORDER BY k)
        || '</pre><table class="evidence-table"><thead><tr><th>region</th><th>nation</th></tr></thead><tbody>' || string_agg('<tr>' || CASE WHEN k > 1 THEN '' WHEN n > 1 THEN '<td rowspan="' || n || '">' || r_name || '</td>' ELSE '<td>' || r_name || '</td>' END || '<td>' || n_name || '</td></tr>', '' ORDER BY k) || '</tbody></table></section>') AS body_md5 FROM r GROUP BY 1""",
    "figure_pages": """SELECT p_partkey AS doc_id, md5('<h1>Evidence units</h1><section class="unit"><header><code>b1</code> image</header><pre>image: img-0001' || chr(10) || 'caption: ' || p_type || chr(10) || 'alt: part</pre><figure><img src="s3://evidence/assets/img-0001.png" alt="' || p_type || '"><figcaption>' || p_type || '</figcaption><a href="s3://evidence/assets/img-0001.png">s3://evidence/assets/img-0001.png</a><p class="asset-meta">image/png · '
        || strlen(p_name) || ' bytes · ' || sha256(p_name) || '</p></figure></section>') AS body_md5 FROM part WHERE p_partkey % 4 = 0""",
    "evidence_json": "SELECT l_orderkey AS doc_id, 1 AS units, count(*)::INT AS \"rows\" FROM lineitem GROUP BY 1",
    "scan_status": """SELECT DISTINCT n_regionkey + k AS doc_id, s AS status, u AS n_units, t AS unit_types FROM nation, (VALUES (0::BIGINT, 'ok', 2, 'table,text'), (100000000, 'ok', 2, 'table,text'), (1000000000, 'parse_error', 0, ''), (1100000000, 'skipped', 0, '')) AS v(k, s, u, t)""",
    "diagram_profiles": """WITH g AS (SELECT n_regionkey::BIGINT AS doc_id, count(*) AS n FROM nation GROUP BY 1)
        SELECT doc_id, n AS nodes, n AS bbox_nodes, n - 1 AS connectors, n - 1 AS edges, 0::BIGINT AS labeled_edges, n - 1 AS source_relation_lines, 1.0::DOUBLE AS bbox_node_ratio, (n - 1) * 11 AS score, 'diagram_connectors,inferred_edges,unlabeled_edges' || CASE WHEN n > 10 THEN ',many_connectors,many_inferred_edges' ELSE '' END AS flags FROM g""",
    "table_outliers": """WITH r AS (SELECT o_orderkey % 20 AS doc_id, c_mktsegment, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), g AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1)
        SELECT doc_id, 1 AS rank, 60::BIGINT AS columns, n * 60 AS cells, n * 57 AS blank_cells, 60 + n * 3 AS score, 'wide_table' || CASE WHEN n * 60 >= 1000 THEN ',large_table' ELSE '' END || CASE WHEN n * 60 >= 50 THEN ',sparse_table' ELSE '' END AS flags FROM g""",
}
for _name in ("scan_status", "diagram_profiles"):
    ORACLES[_name] = synthetic.grouped_sql(ORACLES[_name])
