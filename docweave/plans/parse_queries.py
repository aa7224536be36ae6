"""Reading documents: pages and texts as they are, and documents made from the tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import assets, profiles
from docweave.plans import synthetic
from docweave.sources import evidence, markdown
from docweave.sources.registry import default_readers
from docweave.sources.spread import spread
from docweave.sources.store import written


def _read(docs: DataFrame) -> DataFrame:
    return evidence.read(docs, default_readers())


def _pages(spark, sf_dir) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return _read(pages.select(F.col("page_id").alias("doc_id"), F.lit(".html").alias("suffix"), F.col("html").alias("content")))


def _cells(docs: DataFrame) -> DataFrame:
    return evidence.cells(evidence.units(_read(docs))).where("section = 'body'").select("doc_id", "row_index", "column_id", "text", "rowspan")


def html_units(spark, sf_dir):
    units = evidence.units(_pages(spark, sf_dir))
    return units.select("doc_id", "ord", "id", "type", "source_text", "content", F.array_join("section_path", " > ").alias("section"))


def html_sections(spark, sf_dir):
    units = evidence.units(_pages(spark, sf_dir))
    return units.groupBy(F.coalesce(F.get("section_path", F.lit(0)), F.lit("")).alias("section"), "type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def html_table_cells(spark, sf_dir):
    return _cells(synthetic.order_pages(spark, sf_dir))


def html_rowspans(spark, sf_dir):
    return _cells(synthetic.region_page(spark, sf_dir))


def html_table_source(spark, sf_dir):
    units = evidence.units(_read(synthetic.order_pages(spark, sf_dir)))
    return units.select("doc_id", "id", "type", "source_text")


def html_nested_tables(spark, sf_dir):
    nodes = evidence.nodes(evidence.units(_read(synthetic.nested_pages(spark, sf_dir))))
    return nodes.select("doc_id", "node", F.coalesce("parent", F.lit("")).alias("parent"), "depth", "type", "n_rows", "n_columns")


def html_images(spark, sf_dir):
    found = _read(synthetic.image_pages(spark, sf_dir))
    held = evidence.assets(found).select("doc_id", F.lit("asset").alias("kind"), F.col("id").alias("name"), F.sha2("data", 256).alias("detail"))
    said = evidence.warnings(found).select("doc_id", F.lit("warning"), F.col("type"), F.col("severity"))
    return held.union(said)


def assets_resolved(spark, sf_dir):
    """The put only names where an asset would go; folder_sink writes it."""
    docs = synthetic.image_pages(spark, sf_dir)
    found = _read(docs)
    named = docs.select("doc_id", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"))
    kept = assets.stored(evidence.assets(found), named, lambda key, data, mime: f"s3://evidence/{hashlib.sha256(data).hexdigest()[:8]}/{key[65:]}")
    content = F.from_json("content", "asset_id string, caption string, uri string, bytes long, mime string")
    return assets.resolved(evidence.units(found), kept).select("doc_id", "id", content.alias("c")).select("doc_id", "id", "c.asset_id", "c.caption", "c.uri", "c.bytes", "c.mime")


def asset_orphans(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    references = parts.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("img-000"), F.col("p_size") % 3).alias("asset_id"))
    known = parts.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("img-000"), F.col("p_size") % 2).alias("id"))
    return assets.orphans(references, known)


def text_units(spark, sf_dir):
    return markdown.scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "ord", "type", "section", "n_lines", F.md5("content").alias("content_md5"))


def _markdown(spark, sf_dir) -> DataFrame:
    nations = synthetic.members(spark, sf_dir).groupBy("n_regionkey").agg(synthetic.joined("concat('| ', n_nationkey, ' | ', n_name, ' |\n')", "n_nationkey").alias("rows"))
    both = nations.join(synthetic.groups(spark, sf_dir), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("# "), "r_name", F.lit("\nabout it\n\n| key | name |\n|---|---|\n"), "rows", F.lit("\nend\n")).alias("text"))


def markdown_units(spark, sf_dir):
    return markdown.scan(_markdown(spark, sf_dir)).select("doc_id", "ord", "type", "section", "n_lines", "content")


def markdown_cells(spark, sf_dir):
    return markdown.table_cells(markdown.scan(_markdown(spark, sf_dir))).select("doc_id", "row_index", "column_id", "header", "text")


def hwpx_cells(spark, sf_dir):
    return _cells(synthetic.hwpx_regions(spark, sf_dir))


def hwp5_cells(spark, sf_dir):
    return _cells(synthetic.hwp5_regions(spark, sf_dir))


def layout_cells(spark, sf_dir):
    return _cells(synthetic.layout_regions(spark, sf_dir))


def mixed_formats(spark, sf_dir):
    """One scan over documents of five formats."""
    docs = None
    for n, made in enumerate((synthetic.nested_pages, synthetic.hwpx_regions, synthetic.hwp5_regions, synthetic.layout_regions)):
        own = made(spark, sf_dir)
        own = own.select((F.col("doc_id") + 10_000_000 * n).alias("doc_id"), "suffix", F.col("content").cast("binary").alias("content"))
        docs = own if docs is None else docs.union(own)
    return evidence.units(_read(docs)).groupBy((F.col("doc_id") / 10_000_000).cast("int").alias("format_no"), "type").agg(F.count("*").alias("n"))


def table_profiles(spark, sf_dir):
    found = profiles.table_profiles(evidence.units(_read(synthetic.order_pages(spark, sf_dir))))
    return found.select("doc_id", "id", "columns", "rows", "cells", "blank_cells", "blank_ratio", "span_cells", "score", "flags")


def document_summaries(spark, sf_dir):
    found = written(_read(synthetic.order_pages(spark, sf_dir).union(synthetic.image_pages(spark, sf_dir).selectExpr("doc_id + 100000000", "suffix", "content"))))
    rows = profiles.document_summaries(evidence.units(found), evidence.assets(found), evidence.warnings(found))
    return rows.select("doc_id", "n_units", "n_table", "n_image", "total_cells", "total_rows", "asset_count", "asset_bytes", "n_warnings", "warning_types")


def corpus_summary(spark, sf_dir):
    found = written(_read(synthetic.order_pages(spark, sf_dir)))
    return profiles.corpus_summary(profiles.document_summaries(evidence.units(found), evidence.assets(found), evidence.warnings(found)))


def review_rollup(spark, sf_dir):
    docs = synthetic.image_pages(spark, sf_dir)
    found = written(_read(docs))
    flags = profiles.review_flags(profiles.document_summaries(evidence.units(found), evidence.assets(found), evidence.warnings(found), docs))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("size"), F.col("p_size") % 3).alias("band"))
    results = parts.join(flags, "doc_id").select("doc_id", "band", F.lit("ok").alias("status"), "flags")
    return profiles.band_rollup(results).select(F.coalesce("band", F.lit("all")).alias("band"), "measure", "n")


QUERIES = {f.__name__: f for f in (html_units, html_sections, html_table_cells, html_rowspans, html_table_source, html_nested_tables, html_images, assets_resolved, asset_orphans, text_units, markdown_units, markdown_cells, hwpx_cells, hwp5_cells, layout_cells, mixed_formats, table_profiles, document_summaries, corpus_summary, review_rollup)}

_NATION_CELLS = """WITH r AS (SELECT n_regionkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS row_index, n_nationkey, n_name FROM nation)
    SELECT doc_id, row_index, 'c1' AS column_id, n_nationkey::VARCHAR AS text, 1 AS rowspan FROM r UNION ALL SELECT doc_id, row_index, 'c2', n_name, 1 FROM r"""
_ORDER_ROWS = "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, concat(l_partkey, '</td><td>', l_quantity::INT, '</td><td>', l_returnflag))::INT AS row_index, * FROM lineitem"
ORACLES = {
    "html_table_cells": f"""WITH r AS ({_ORDER_ROWS}) SELECT doc_id, row_index, column_id, text, 1 AS rowspan FROM (
        SELECT doc_id, row_index, 'c1' AS column_id, l_linenumber::VARCHAR AS text FROM r UNION ALL SELECT doc_id, row_index, 'c2', l_partkey::VARCHAR FROM r
        UNION ALL SELECT doc_id, row_index, 'c3', l_quantity::INT::VARCHAR FROM r UNION ALL SELECT doc_id, row_index, 'c4', l_returnflag FROM r)""",
    "html_rowspans": """WITH r AS (SELECT row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey)::INT AS row_index, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS k, (count(*) OVER (PARTITION BY r_regionkey))::INT AS n, * FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT r_regionkey::BIGINT AS doc_id, row_index, 'c1' AS column_id, r_name AS text, n AS rowspan FROM r WHERE k = 1 UNION ALL SELECT r_regionkey, row_index, 'c2', n_name, 1 FROM r""",
    "html_table_source": f"""WITH r AS ({_ORDER_ROWS}) SELECT doc_id, 'b1' AS id, 'table' AS type, 'section: Order ' || doc_id || chr(10) || 'caption: Lines' || chr(10) || 'columns: line | part | quantity | flag' || chr(10) ||
        string_agg('row ' || row_index || ': line=' || l_linenumber || '; part=' || l_partkey || '; quantity=' || l_quantity::INT || '; flag=' || l_returnflag, chr(10) ORDER BY row_index) AS source_text FROM r GROUP BY doc_id""",
    "html_nested_tables": """SELECT r_regionkey::BIGINT AS doc_id, 'b1' AS node, '' AS parent, 0 AS depth, 'table' AS type, 1 AS n_rows, 2 AS n_columns FROM region
        UNION ALL SELECT r_regionkey, 'b1.1', 'b1', 1, 'table', count(n_nationkey)::INT, 2 FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
    "html_images": """SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'asset' ELSE 'warning' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'img-0001' WHEN 1 THEN 'html_image_data_uri_invalid' WHEN 2 THEN 'html_image_mime_unsupported' ELSE 'html_image_external_reference' END AS name,
        CASE p_partkey % 4 WHEN 0 THEN sha256(p_name) ELSE 'medium' END AS detail FROM part""",
    "assets_resolved": "SELECT p_partkey AS doc_id, 'b1' AS id, 'img-0001' AS asset_id, p_type AS caption, 's3://evidence/' || left(sha256(p_name), 8) || '/assets/img-0001.png' AS uri, strlen(p_name)::BIGINT AS bytes, 'image/png' AS mime FROM part WHERE p_partkey % 4 = 0",
    "asset_orphans": "SELECT p_partkey AS doc_id, 'img-000' || p_size % 3 AS asset_id FROM part WHERE p_size % 3 <> p_size % 2",
    "text_units": """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS n FROM documents WHERE text <> ''),
        k AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
        t AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN bare LIKE '#%' THEN 'heading' WHEN bare LIKE '|%' THEN 'table' ELSE 'text' END AS type FROM k),
        s AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN trim(regexp_replace(line, '^#+', '')) END IGNORE NULLS) OVER w AS section, (type IS DISTINCT FROM lag(type) OVER w)::INT AS b FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
        g AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM s)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block)::INT AS ord, type, coalesce(first(section ORDER BY n), '') AS section, count(*) AS n_lines, md5(string_agg(bare, chr(10) ORDER BY n)) AS content_md5
        FROM g WHERE type IN ('text', 'table') GROUP BY doc_id, block, type""",
    "markdown_units": """WITH t AS (SELECT n_regionkey, count(*) AS n, '| key | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS body FROM nation GROUP BY 1)
        SELECT r_regionkey::BIGINT AS doc_id, ord::INT AS ord, type, r_name AS section, n_lines, content FROM region JOIN t ON n_regionkey = r_regionkey, LATERAL (VALUES (1, 'text', 1::BIGINT, 'about it'), (2, 'table', n + 2, body), (3, 'text', 1::BIGINT, 'end')) AS v(ord, type, n_lines, content)""",
    "markdown_cells": """WITH r AS (SELECT n_regionkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS row_index, * FROM nation)
        SELECT doc_id, row_index, 'c1' AS column_id, 'key' AS header, n_nationkey::VARCHAR AS text FROM r UNION ALL SELECT doc_id, row_index, 'c2', 'name', n_name FROM r""",
    "hwpx_cells": _NATION_CELLS,
    "hwp5_cells": _NATION_CELLS,
    "layout_cells": _NATION_CELLS,
    "mixed_formats": "SELECT f AS format_no, t AS type, count(*) AS n FROM region, (VALUES (0, 'table'), (1, 'text'), (1, 'table'), (2, 'text'), (2, 'table'), (3, 'text'), (3, 'table')) AS v(f, t) WHERE r_regionkey IN (SELECT n_regionkey FROM nation) OR f = 0 GROUP BY 1, 2",
    "table_profiles": """SELECT l_orderkey AS doc_id, 'b1' AS id, 4::BIGINT AS columns, count(*) AS rows, count(*) * 4 AS cells, 0::BIGINT AS blank_cells, 0.0::DOUBLE AS blank_ratio, 0::BIGINT AS span_cells, 4 + count(*) * 4 AS score, '' AS flags FROM lineitem GROUP BY 1""",
    "document_summaries": """SELECT l_orderkey AS doc_id, 1::BIGINT AS n_units, 1::BIGINT AS n_table, 0::BIGINT AS n_image, count(*) * 4 AS total_cells, count(*) AS total_rows, 0::BIGINT AS asset_count, 0::BIGINT AS asset_bytes, 0::BIGINT AS n_warnings, '' AS warning_types FROM lineitem GROUP BY 1
        UNION ALL SELECT p_partkey + 100000000, 1, 0, 1, 0, 0, 1, strlen(p_name), 0, '' FROM part WHERE p_partkey % 4 = 0""",
    "corpus_summary": """WITH d AS (SELECT count(DISTINCT l_orderkey) AS docs, count(*) AS n FROM lineitem) SELECT m AS measure, v::BIGINT AS total FROM d, LATERAL (VALUES ('documents', docs), ('n_text', 0), ('n_table', docs), ('n_image', 0), ('n_diagram', 0), ('total_cells', n * 4), ('total_nodes', 0), ('total_connectors', 0), ('total_edges', 0), ('asset_count', 0)) AS x(m, v)""",
    "review_rollup": """WITH r AS (SELECT 'size' || p_size % 3 AS band, p_partkey % 4 = 0 AS ok FROM part), g AS (SELECT band, count(*) AS n, count(*) FILTER (NOT ok) AS f, count(*) FILTER (ok) AS k FROM r GROUP BY ROLLUP (band))
        SELECT coalesce(band, 'all') AS band, m AS measure, v AS n FROM g, LATERAL (VALUES ('documents', n), ('failed', 0), ('flag:low_text_with_assets', k), ('flag:no_units', f)) AS x(m, v)""",
}
#: The article of a page, without tags, under its heading.
_ARTICLES = r"""SELECT page_id AS doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) AS section,
    trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)</h1>(.*)</article>', 1), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS content FROM pages"""
ORACLES["html_units"] = f"SELECT doc_id, 1::INT AS ord, 'b1' AS id, 'text' AS type, CASE WHEN section = '' THEN content ELSE 'section: ' || section || chr(10) || content END AS source_text, content, section FROM ({_ARTICLES}) WHERE content <> ''"
ORACLES["html_sections"] = f"SELECT section, 'text' AS type, count(*) AS n, count(DISTINCT doc_id) AS documents FROM ({_ARTICLES}) WHERE content <> '' GROUP BY section"
for _name in ("html_rowspans", "html_nested_tables", "markdown_units", "markdown_cells", "hwpx_cells", "hwp5_cells", "layout_cells", "mixed_formats"):
    ORACLES[_name] = synthetic.grouped_sql(ORACLES[_name])
