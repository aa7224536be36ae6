"""Profiles of tables, diagrams, documents and the whole corpus, with the flags that mark outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.sources import evidence

_DIAGRAM = "nodes array<struct<id: string, text: string, bbox: struct<x: double, y: double, width: double, height: double>>>, edges array<struct<label: string>>, connectors array<struct<id: string>>"


def _flags(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in pairs))), ",")


def table_flags(columns: Column, cells: Column, blank_ratio: Column, span_cells: Column) -> Column:
    return _flags([(columns >= 50, "wide_table"), (cells >= 1000, "large_table"), ((cells >= 50) & (blank_ratio >= 0.85), "sparse_table"), (span_cells >= 100, "span_heavy_table")])


def diagram_flags(connectors: Column, edges: Column, unlabeled: Column) -> Column:
    return _flags([(connectors > 0, "diagram_connectors"), (edges > 0, "inferred_edges"), (connectors > edges, "connector_without_edges"), (unlabeled > 0, "unlabeled_edges"), (connectors >= 10, "many_connectors"), (edges >= 10, "many_inferred_edges")])


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    """Rounded half to even; 0 of nothing."""
    return F.when(whole > 0, F.bround(part / whole, digits)).otherwise(0.0)


def table_profiles(units: DataFrame) -> DataFrame:
    """One row per table unit: its size, blanks, spans, score and flags."""
    rows = lambda name: F.coalesce(f"t.{name}", F.array())
    every = F.flatten(F.transform(F.concat(rows("header_rows"), rows("rows")), lambda r: r["cells"]))
    nested = lambda c: F.coalesce(F.json_array_length(c["children"]), F.lit(0))
    wide, tall = (lambda c: F.coalesce(c["colspan"], F.lit(1)) > 1), (lambda c: F.coalesce(c["rowspan"], F.lit(1)) > 1)
    n = lambda fits: F.size(F.filter("every", fits)).cast("long")
    both = evidence.tables(units).withColumn("every", every).select(
        "doc_id",
        "id",
        *(F.size(rows(x)).cast("long").alias(x) for x in ("columns", "header_rows", "rows")),
        F.size("every").cast("long").alias("cells"),
        n(lambda c: (F.trim(c["text"]) == "") & (nested(c) == 0)).alias("blank_cells"),
        n(lambda c: wide(c) | tall(c)).alias("span_cells"),
        n(tall).alias("rowspan_cells"),
        n(wide).alias("colspan_cells"),
        F.aggregate("every", F.lit(0), lambda acc, c: acc + nested(c)).cast("long").alias("nested_children"),
    )
    c = F.col
    return both.withColumn("blank_ratio", ratio(c("blank_cells"), c("cells"))).withColumns({"score": c("columns") + c("cells") - c("blank_cells") + 2 * c("span_cells"), "flags": table_flags(c("columns"), c("cells"), c("blank_ratio"), c("span_cells"))})


def diagram_profiles(units: DataFrame) -> DataFrame:
    d = units.where("type = 'diagram'").withColumn("d", F.from_json("content", _DIAGRAM))
    size = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    rows = d.select(
        "doc_id",
        "id",
        size("d.nodes").alias("nodes"),
        size(F.filter("d.nodes", lambda n: (n["bbox"]["width"] > 0) & (n["bbox"]["height"] > 0))).alias("bbox_nodes"),
        size("d.connectors").alias("connectors"),
        size("d.edges").alias("edges"),
        size(F.filter("d.edges", lambda e: F.trim(e["label"]) != "")).alias("labeled_edges"),
        size(F.filter(F.split("source_text", "\n"), lambda x: F.contains(x, F.lit(" -> ")))).alias("source_relation_lines"),
    )
    c = F.col
    rows = rows.withColumn("unlabeled_edges", c("edges") - c("labeled_edges"))
    score = c("connectors") * 3 + c("edges") * 4 + c("unlabeled_edges") * 3 + c("labeled_edges") * 2 + c("source_relation_lines")
    return rows.withColumns({"bbox_node_ratio": ratio(c("bbox_nodes"), c("nodes")), "connector_edge_ratio": ratio(c("edges"), c("connectors")), "score": score, "flags": diagram_flags(c("connectors"), c("edges"), c("unlabeled_edges"))})


def outliers(profiles: DataFrame, per_document: int = 10) -> DataFrame:
    """The flagged profiles of highest score of each document, ranked; equal scores in order of their units."""
    at = F.regexp_extract("id", r"\d+", 0).cast("int")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), at)
    return profiles.where("flags <> ''").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_document)


def document_summaries(units: DataFrame, assets: DataFrame, warnings: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row per document: counts by type, table and diagram totals, assets, kinds of warnings.

    documents (doc_id) says which were read; without it only those with units are known.
    """
    kinds = units.groupBy("doc_id").agg(F.count("*").alias("n_units"), *(F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("text", "table", "image", "diagram")), F.sum(F.length("source_text")).alias("source_text_chars"))
    tables = table_profiles(units).groupBy("doc_id").agg(F.sum("cells").alias("total_cells"), F.max("columns").alias("max_columns"), F.max("cells").alias("max_cells"), F.sum("blank_cells").alias("blank_cells"), F.sum("rows").alias("total_rows"))
    drawn = diagram_profiles(units).groupBy("doc_id").agg(F.sum("nodes").alias("total_nodes"), F.sum("connectors").alias("total_connectors"), F.sum("edges").alias("total_edges"))
    held = assets.groupBy("doc_id").agg(F.count("*").alias("asset_count"), F.sum(F.length("data")).alias("asset_bytes"))
    said = warnings.groupBy("doc_id").agg(F.count("*").alias("n_warnings"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("warning_types"))
    joined = kinds if documents is None else documents.select("doc_id").distinct().join(kinds, "doc_id", "left")
    for other in (tables, drawn, held, said):
        joined = joined.join(other, "doc_id", "left")
    return joined.fillna(0).fillna("", ["warning_types"])


def review_flags(summaries: DataFrame) -> DataFrame:
    """doc_id and the flags that ask for a look at a document."""
    c = F.col
    return summaries.select(
        "doc_id",
        _flags(
            [
                (c("n_units") == 0, "no_units"),
                ((c("source_text_chars") < 200) & (c("asset_count") > 0), "low_text_with_assets"),
                ((c("n_table") > 0) & (ratio(c("blank_cells"), c("total_cells")) >= 0.45), "high_table_blank_ratio"),
                (F.array_contains(F.split("warning_types", ","), "pdf_ocr_failed"), "ocr_failed"),
                (c("n_warnings") >= 10, "many_quality_warnings"),
            ]
        ).alias("flags"),
    )


def corpus_summary(summaries: DataFrame) -> DataFrame:
    """measure, total over all documents; kinds of warnings by the documents that have them."""
    names = ["n_text", "n_table", "n_image", "n_diagram", "total_cells", "total_nodes", "total_connectors", "total_edges", "asset_count"]
    sums = summaries.agg(F.count("*").alias("documents"), *(F.sum(n).alias(n) for n in names))
    totals = sums.unpivot([], ["documents", *names], "measure", "total")
    said = summaries.where("warning_types <> ''").select(F.explode(F.split("warning_types", ",")).alias("t")).groupBy("t").count()
    return totals.union(said.select(F.concat(F.lit("warning:"), "t"), "count")).select("measure", F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def band_rollup(results: DataFrame) -> DataFrame:
    """By band and over all (band null): documents, failures and flags; results (doc_id, band, status, flags)."""
    flag = F.explode_outer(F.split(F.nullif("flags", F.lit("")), ","))
    totals = results.groupingSets([["band"], []], "band").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("failed"))
    flags = results.select("band", flag.alias("flag")).where("flag is not null").groupingSets([["band", "flag"], ["flag"]], "band", "flag").agg(F.count("*").alias("n"))
    return totals.select("band", F.lit("documents").alias("measure"), "n").union(totals.select("band", F.lit("failed"), "failed")).union(flags.select("band", F.concat(F.lit("flag:"), "flag"), "n"))
