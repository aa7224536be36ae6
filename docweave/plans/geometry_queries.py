"""Boxes and connectors derived from the parts and lines: edges, nesting, free bands, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import diagrams, layout


def _boxes(spark, sf_dir):
    """Forty to a diagram, on a coarse grid."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    return p.select((k / 40).cast("long").alias("diagram"), k.alias("node"), k.alias("ord"), (k * 37 % 101 * 10).alias("x"), (k * 53 % 97 * 10).alias("y"), (F.col("p_size") % 7 * 5).alias("w"), (F.col("p_size") % 5 * 5 + 5).alias("h"))


def _connectors(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    return s.select((k / 40).cast("long").alias("diagram"), k.alias("connector"), (k * 29 % 1000).alias("x1"), (k * 31 % 1000).alias("y1"), (k * 41 % 1000).alias("x2"), (k * 43 % 1000).alias("y2"), (k * 3 % 40 + 40 * (k / 40).cast("long")).alias("start_subject"), F.when(k % 3 > 0, k * 7 % 40 + 40 * (k / 40).cast("long")).alias("end_subject"))


def nearest_edges(spark, sf_dir):
    return diagrams.inferred_edges(_boxes(spark, sf_dir), _connectors(spark, sf_dir))


def subject_edges(spark, sf_dir):
    boxes, connectors = _boxes(spark, sf_dir), _connectors(spark, sf_dir)
    nodes = boxes.select("diagram", "node", "ord", F.when(F.col("node") % 4 > 0, F.col("node")).alias("instance_id"))
    return diagrams.resolved_by_subject(connectors, nodes, diagrams.inferred_edges(boxes, connectors))


def loose_connectors(spark, sf_dir):
    boxes, connectors = _boxes(spark, sf_dir), _connectors(spark, sf_dir)
    return diagrams.unresolved(connectors, diagrams.inferred_edges(boxes, connectors)).select("diagram", "connector")


def _placed(spark, sf_dir):
    return _boxes(spark, sf_dir).select(F.col("diagram").alias("page"), F.col("node").alias("box"), F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("top"), (F.col("x") + F.col("w")).cast("double").alias("x1"), (F.col("y") + F.col("h")).cast("double").alias("bottom"))


def containing_cells(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    cells = rows.selectExpr("page", "box as cell", "x0 - 100 as x0", "top - 100 as top", "x1 + 150 as x1", "bottom + 150 as bottom")
    return layout.containing(rows.withColumnRenamed("box", "item"), cells)


def free_bands(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    return layout.free_bands(rows.select("page", "top", "bottom"), rows.select("page").distinct().withColumn("height", F.lit(1000.0)))


def vertical_clusters(spark, sf_dir):
    return layout.clusters(_placed(spark, sf_dir), 15.0).groupBy("page", "cluster").agg(F.count("*").alias("n"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def read_texts_not_native(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.substring("text", 5, 20).alias("text")), F.struct(F.lit(2).alias("n"), F.concat(F.lit("read: "), F.substring("text", 1, 9)).alias("text")))).alias("r")).select("doc_id", "r.n", "r.text")
    return layout.without_native(read, docs.select("doc_id", "text")).select("doc_id", "n")


QUERIES = {f.__name__: f for f in (nearest_edges, subject_edges, loose_connectors, containing_cells, free_bands, vertical_clusters, read_texts_not_native)}

_B = "SELECT p_partkey // 40 AS diagram, p_partkey AS node, p_partkey * 37 % 101 * 10 AS x, p_partkey * 53 % 97 * 10 AS y, p_size % 7 * 5 AS w, p_size % 5 * 5 + 5 AS h FROM part"
_C = "SELECT p_partkey // 40 AS diagram, p_partkey AS connector, p_partkey * 29 % 1000 AS x1, p_partkey * 31 % 1000 AS y1, p_partkey * 41 % 1000 AS x2, p_partkey * 43 % 1000 AS y2, p_partkey * 3 % 40 + 40 * (p_partkey // 40) AS s, CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 7 % 40 + 40 * (p_partkey // 40) END AS e FROM part"
_D = "pow(greatest(x - {0}, 0, {0} - x - w), 2) + pow(greatest(y - {1}, 0, {1} - y - h), 2)"
_EDGES = f"""b AS ({_B}), c AS ({_C}), j AS (SELECT c.*, node, row_number() OVER (PARTITION BY connector ORDER BY {_D.format('x1', 'y1')}, node) AS ka, row_number() OVER (PARTITION BY connector ORDER BY {_D.format('x2', 'y2')}, node) AS kz FROM c JOIN b USING (diagram) WHERE w > 0),
    g AS (SELECT diagram, connector, max(node) FILTER (ka = 1) AS from_id, max(node) FILTER (kz = 1) AS to_id FROM j GROUP BY 1, 2)"""
_P = f"SELECT diagram AS page, node AS box, x::DOUBLE AS x0, y::DOUBLE AS top, (x + w)::DOUBLE AS x1, (y + h)::DOUBLE AS bottom FROM ({_B})"
ORACLES = {
    "nearest_edges": f"WITH {_EDGES} SELECT * FROM g WHERE from_id <> to_id",
    "subject_edges": f"""WITH {_EDGES}, f AS (SELECT * FROM g WHERE from_id <> to_id), r AS (SELECT c.diagram, c.connector, s % 4 > 0 AND e % 4 > 0 AND s <> e AS ok, s, e, from_id, to_id FROM c LEFT JOIN f USING (diagram, connector))
        SELECT diagram, connector, CASE WHEN ok AND ok IS NOT NULL THEN s ELSE from_id END AS from_id, CASE WHEN ok AND ok IS NOT NULL THEN e ELSE to_id END AS to_id, CASE WHEN ok AND ok IS NOT NULL THEN 'parsed_subject_ids' ELSE 'inferred_geometry' END AS confidence FROM r WHERE coalesce(ok, false) OR from_id IS NOT NULL""",
    "loose_connectors": f"WITH {_EDGES} SELECT diagram, connector FROM c WHERE connector NOT IN (SELECT connector FROM g WHERE from_id <> to_id)",
    "containing_cells": f"""WITH p AS ({_P}), c AS (SELECT page, box AS cell, x0 - 100 AS x0, top - 100 AS top, x1 + 150 AS x1, bottom + 150 AS bottom FROM p),
        j AS (SELECT p.page, p.box AS item, cell, row_number() OVER (PARTITION BY p.box ORDER BY (c.x1 - c.x0) * (c.bottom - c.top), cell) AS k FROM p JOIN c ON p.page = c.page AND p.x0 >= c.x0 - 2 AND p.x1 <= c.x1 + 2 AND p.top >= c.top - 2 AND p.bottom <= c.bottom + 2)
        SELECT page, item, cell FROM j WHERE k = 1""",
    "free_bands": f"""WITH p AS ({_P}), w AS (SELECT page, coalesce(max(bottom) OVER (PARTITION BY page ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, top AS z FROM p UNION ALL SELECT page, max(bottom), 1000.0 FROM p GROUP BY 1)
        SELECT page, a AS top, z AS bottom FROM w WHERE z > a + 2""",
    "vertical_clusters": f"""WITH p AS ({_P}), f AS (SELECT *, coalesce(top - max(bottom) OVER (PARTITION BY page ORDER BY top, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 15, false)::INT AS b FROM p),
        c AS (SELECT *, sum(b) OVER (PARTITION BY page ORDER BY top, box)::BIGINT AS cluster FROM f) SELECT page, cluster, count(*) AS n, min(top) AS top, max(bottom) AS bottom FROM c GROUP BY 1, 2""",
    "read_texts_not_native": """WITH r AS (SELECT doc_id, 1 AS n, substring(text, 5, 20) AS t, text FROM documents UNION ALL SELECT doc_id, 2, 'read: ' || substring(text, 1, 9), text FROM documents)
        SELECT doc_id, n FROM r WHERE regexp_replace(t, '\\s+', '', 'g') <> '' AND NOT contains(regexp_replace(text, '\\s+', '', 'g'), regexp_replace(t, '\\s+', '', 'g'))""",
}
