"""Chunks: windows, fallbacks, plans and their repairs, boundaries, packs, enrichment."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import ranges, text as t
from docweave.operators import chunking, enrichment, passes
from docweave.plans import synthetic
from docweave.plans.parse_queries import _ORDER_ROWS
from docweave.sources.registry import default_readers
from docweave.sources.spread import spread


def _lines(spark, sf_dir) -> DataFrame:
    """A unit per line of each document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line")).where("line <> ''")
    common = F.to_json(F.struct(F.struct(F.lit("text").alias("chunk_kind"), F.array().cast("array<string>").alias("section_path"), F.lit("plain").alias("display_format")).alias("common")))
    return rows.select("doc_id", "ord", F.concat(F.lit("b"), F.col("ord")).alias("id"), F.lit("text").alias("type"), F.lit("plain").alias("format"), F.col("line").alias("source_text"), F.col("line").alias("content"), F.array().cast("array<string>").alias("section_path"), common.alias("metadata"))


def _chunked(spark, sf_dir, *columns: str, **how) -> DataFrame:
    """The chunks of a page per order."""
    return passes.chunks(synthetic.order_pages(spark, sf_dir), default_readers(), columns=("doc_id", *columns), **how)


def unit_windows(spark, sf_dir):
    return chunking.window_of(_lines(spark, sf_dir), 4).groupBy("doc_id", "window").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"))


def fallback_chunks(spark, sf_dir):
    rows = chunking.fallback_chunks(_lines(spark, sf_dir))
    return rows.select("doc_id", "ord", "id", "summary", F.array_join("keywords", " ").alias("keywords"), "question")


def chunk_fallback_units(spark, sf_dir):
    """The chunker without a planner, unit by unit the same as the projection."""
    rows = chunking.chunks(_lines(spark, sf_dir))
    return rows.select("doc_id", "ord", "id", F.array_join("unit_ids", " ").alias("unit_ids"), F.array_join("keywords", " ").alias("keywords"))


def _odd_even(window: list[dict], most: int) -> list[dict]:
    """Takes the first two rows of each table, so that the others are left out."""
    return [{"title": "first", "operations": [{"unit_id": u["id"], "action": "include_rows", "row_ranges": [[1, min(2, len(u["content"]["rows"]))]]}]} for u in window]


def plan_row_repairs(spark, sf_dir):
    rows = _chunked(spark, sf_dir, "ord", "metadata", plan=_odd_even)
    operation = F.from_json(F.get_json_object("metadata", "$.operations[0].row_ranges"), "array<array<bigint>>")
    return rows.select("doc_id", "ord", ranges.label(operation).alias("rows"), F.get_json_object("metadata", "$._fallback_reason").isNotNull().cast("int").alias("repaired"))


def _pairs(window: list[dict], most: int) -> list[dict]:
    """Two units each; every fifth unit is forgotten."""
    kept = [u["id"] for u in window if int(u["id"][1:]) % 5 != 4]
    return [{"operations": [{"unit_id": x} for x in kept[i : i + 2]]} for i in range(0, len(kept), 2)]


def plan_unit_repairs(spark, sf_dir):
    rows = chunking.chunks(_lines(spark, sf_dir), plan=_pairs)
    return rows.select("doc_id", "id", F.explode("unit_ids").alias("unit_id")).groupBy("doc_id").agg(F.count("*").alias("n_units"), F.countDistinct("unit_id").alias("n_distinct"))


def _faulty(window: list[dict], most: int) -> list[dict]:
    """Plans that break a rule, by the document's first unit."""
    first = window[0]["id"]
    kind = len(window[0]["source"]["text"]) % 4
    faults = [[{"operations": [{"unit_id": "nowhere"}]}], [{"operations": [{"unit_id": first}, {"unit_id": first}]}], [{"operations": []}], [{"operations": [{"unit_id": first}], "context_unit_ids": [first]}]]
    return faults[kind]


def plan_faults(spark, sf_dir):
    rows = chunking.chunks(_lines(spark, sf_dir), plan=_faulty)
    return rows.select("doc_id", "ord", F.get_json_object("metadata", "$._fallback_reason").alias("reason"))


def omitted_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.lit("b1").alias("unit_id"), F.col("l_linenumber").alias("row_index")).distinct()
    taken = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.lit("b1").alias("unit_id"), F.lit(2).alias("a"), (F.col("o_orderkey") % 3 + 2).alias("z"))
    return chunking.row_runs(chunking.omitted_rows(rows, taken))


def headings_forward(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    items = lines.select("doc_id", "ord", F.floor(F.col("ord") / 3).alias("chunk"), (F.length("source_text") % 3 == 0).alias("is_heading"))
    return chunking.forwarded(items).select("doc_id", "ord", "goes_to")


def unit_packs(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("doc_id", "ord", t.estimated_tokens(F.col("source_text")).alias("cost"))
    return chunking.packed(lines, 300, alone=True)


def contiguous_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("n"))
    return rows.select("l_orderkey", ranges.label(ranges.contiguous(F.col("n"))).alias("label"), ranges.label(ranges.contiguous(F.col("n")), "행").alias("row_label"))


def table_splits(spark, sf_dir):
    """Tables of nations and parts cut by a small token budget: every row once."""
    limits = chunking.Limits(target_tokens=60, most_tokens=80)
    rows = _chunked(spark, sf_dir, "metadata", limits=limits)
    cut = F.from_json(F.get_json_object("metadata", "$.operations[0].row_ranges"), "array<array<bigint>>")
    each = rows.select("doc_id", F.explode_outer(cut).alias("r")).select("doc_id", F.coalesce(F.col("r")[0], F.lit(0)).alias("a"), F.coalesce(F.col("r")[1], F.lit(0)).alias("z"))
    return each.groupBy("doc_id").agg(F.sum(F.when(F.col("a") > 0, F.col("z") - F.col("a") + 1).otherwise(0)).alias("rows_cut"), F.count("*").alias("n_chunks")).where("rows_cut > 0").select("doc_id", "rows_cut")


def text_enrichment(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rules = enrichment.text_rules(F.col("text"))
    return docs.select("doc_id", rules["summary"].alias("summary"), F.array_join(rules["keywords"], " ").alias("keywords"), rules["questions"][0].alias("question"))


def chunk_enrichment(spark, sf_dir):
    """Parsed, chunked and enriched: what a search index takes."""
    rows = _chunked(spark, sf_dir, "id", "summary", "questions", "metadata", fill=enrichment.filled)
    return rows.select("doc_id", "id", "summary", F.get("questions", F.lit(0)).alias("question"), F.get_json_object("metadata", "$._enrichment.method").alias("method"))


def question_tables(spark, sf_dir):
    """A table of questions and answers per region."""

    pages = synthetic.members(spark, sf_dir).groupBy("n_regionkey").agg(synthetic.joined("concat('<tr><td>', n_nationkey, '</td><td>Where is ', n_name, '.</td><td>here</td></tr>')", "n_nationkey").alias("rows"))
    docs = pages.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.lit(".html").alias("suffix"), F.concat(F.lit("<table><caption>FAQ</caption><tr><th>연번</th><th>질의</th><th>답변</th></tr>"), "rows", F.lit("</table>")).alias("content"))
    return passes.chunks(docs, default_readers(), fill=enrichment.filled, columns=("doc_id", "summary", "questions")).select("doc_id", "summary", F.array_join("questions", " ").alias("questions"))


def _misnamed(window: list[dict], most: int) -> list[dict]:
    """Pairs whose unit_ids are in the wrong order, or unknown."""
    out = _pairs(window, most)
    return [{**x, "unit_ids": [o["unit_id"] for o in x["operations"]][::-1] if i % 2 else ["nowhere"]} for i, x in enumerate(out)]


def chunk_warnings(spark, sf_dir):
    rows = chunking.chunks(_lines(spark, sf_dir), plan=_misnamed)
    said = F.from_json(F.get_json_object("metadata", "$._warnings"), "array<struct<type:string>>")
    return rows.select(F.explode(said).alias("w")).groupBy("w.type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (unit_windows, fallback_chunks, chunk_fallback_units, plan_row_repairs, plan_unit_repairs, plan_faults, omitted_rows, headings_forward, unit_packs, contiguous_rows, table_splits, text_enrichment, chunk_enrichment, question_tables, chunk_warnings)}

_LINES = "SELECT doc_id, i - 1 AS ord, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE line <> ''"
_TOKENS = r"len(regexp_extract_all(line, '[A-Za-z0-9_]{1,4}|[^\s\x0bA-Za-z0-9_]'))::BIGINT"
_KEYWORDS = "array_to_string(list_slice(list_filter({0}, lambda x, i: list_position({0}, x) = i), 1, 8), ' ')".format("regexp_extract_all({c}, '[0-9A-Za-z가-힣]{{2,}}')")
_BARE = "regexp_replace({c}, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g')"
ORACLES = {
    "unit_windows": f"WITH l AS ({_LINES}), w AS (SELECT *, ((row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) // 4)::INT AS \"window\" FROM l) SELECT doc_id, \"window\", count(*) AS n, min(ord)::INT AS first, max(ord)::INT AS last FROM w GROUP BY 1, 2",
    "fallback_chunks": f"""WITH l AS ({_LINES}), n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY ord))::INT AS k FROM l)
        SELECT doc_id, k AS ord, 'chunk-' || k AS id, left({_BARE.format(c='line')}, 160) AS summary, {_KEYWORDS.format(c='line')} AS keywords,
        CASE WHEN {_BARE.format(c='left(line, 80)')} = '' THEN '이 청크' ELSE {_BARE.format(c='left(line, 80)')} END || '에 대해 무엇을 알 수 있나요?' AS question FROM n""",
    "plan_row_repairs": """WITH c AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT doc_id, 1 AS ord, CASE WHEN n = 1 THEN '1' ELSE '1-2' END AS "rows", 0 AS repaired FROM c UNION ALL SELECT doc_id, 2, CASE WHEN n = 3 THEN '3' ELSE '3-' || n END, 1 FROM c WHERE n > 2""",
    "plan_unit_repairs": f"WITH l AS ({_LINES}) SELECT doc_id, count(*) AS n_units, count(*) AS n_distinct FROM l GROUP BY 1",
    "plan_faults": f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM ({_LINES})), f AS (SELECT *, first_value(line) OVER w AS first, 'b' || first_value(ord) OVER w AS id FROM k WINDOW w AS (PARTITION BY doc_id, (k - 1) // 40 ORDER BY ord))
        SELECT doc_id, k::INT AS ord, CASE length(first) % 4 WHEN 0 THEN 'unknown unit id: ''nowhere''' WHEN 1 THEN 'duplicate unit id: ' || id WHEN 2 THEN 'chunk plan item requires operations' ELSE 'context unit id must refer to a prior assigned unit: ' || id END AS reason FROM f""",
    "omitted_rows": """WITH r AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS i FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)), o AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r WHERE i < 2 OR i > doc_id % 3 + 2)
        SELECT doc_id, 'b1' AS unit_id, min(i)::INT AS a, max(i)::INT AS z FROM o GROUP BY doc_id, k""",
    "headings_forward": f"""WITH l AS (SELECT *, ord // 3 AS chunk, length(line) % 3 = 0 AS h FROM ({_LINES}))
        SELECT a.doc_id, a.ord::INT AS ord, CASE WHEN a.h AND NOT EXISTS (SELECT 1 FROM l b WHERE b.doc_id = a.doc_id AND b.chunk = a.chunk AND b.ord > a.ord AND NOT b.h)
        THEN coalesce((SELECT arg_min(b.chunk, b.ord) FROM l b WHERE b.doc_id = a.doc_id AND b.ord > a.ord AND NOT b.h), (SELECT max(b.chunk) FROM l b WHERE b.doc_id = a.doc_id)) ELSE a.chunk END AS goes_to FROM l a""",
    "unit_packs": f"""WITH RECURSIVE l AS (SELECT doc_id, ord, {_TOKENS} AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM ({_LINES})),
        f AS (SELECT doc_id, ord, k, 0 AS pack, cost AS held, cost > 300 AS closed FROM l WHERE k = 1
        UNION ALL SELECT l.doc_id, l.ord, l.k, CASE WHEN f.closed OR (f.held > 0 AND f.held + l.cost > 300) THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.closed OR (f.held > 0 AND f.held + l.cost > 300) THEN l.cost ELSE f.held + l.cost END, l.cost > 300 FROM f JOIN l ON l.doc_id = f.doc_id AND l.k = f.k + 1)
        SELECT doc_id, ord::INT AS ord, pack::INT AS pack FROM f""",
    "contiguous_rows": """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber AS i FROM lineitem), k AS (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS k FROM r), g AS (SELECT l_orderkey, min(i) AS a, max(i) AS z FROM k GROUP BY l_orderkey, k)
        SELECT l_orderkey, string_agg(CASE WHEN a = z THEN a::VARCHAR ELSE a || '-' || z END, ', ' ORDER BY a) AS label, string_agg(CASE WHEN a = z THEN a || '행' ELSE a || '-' || z || '행' END, ', ' ORDER BY a) AS row_label FROM g GROUP BY 1""",
    "text_enrichment": None,
    "question_tables": """SELECT n_regionkey::BIGINT AS doc_id, 'FAQ Q&A를 다룹니다: Where is ' || min_by(n_name, n_nationkey) || ' / Where is ' || arg_min(n_name, n_nationkey, 2)[2] AS summary, string_agg('Where is ' || n_name || '?', ' ' ORDER BY n_nationkey) FILTER (k <= 5) AS questions
        FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY 1""",
}
ORACLES["chunk_fallback_units"] = f"WITH l AS ({_LINES}) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord))::INT AS ord, 'chunk-' || row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS id, 'b' || ord AS unit_ids, {_KEYWORDS.format(c='line')} AS keywords FROM l"
ORACLES["chunk_warnings"] = f"""WITH w AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) // 40 AS w FROM ({_LINES})), k AS (SELECT doc_id, w, count(*) AS n FROM w WHERE ord % 5 <> 4 GROUP BY 1, 2),
    c AS (SELECT sum((n + 1) // 2 - ((n + 1) // 2) // 2) AS unknown, sum(n // 4) AS swapped FROM k)
    SELECT 'agentic_plan_unit_ids_ignored' AS type, unknown::BIGINT AS n FROM c UNION ALL SELECT 'agentic_plan_unit_ids_mismatch', swapped::BIGINT FROM c WHERE swapped > 0"""
ORACLES["chunk_enrichment"] = """WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, concat(l_partkey, '</td><td>', l_quantity::INT, '</td><td>', l_returnflag)) AS i, * FROM lineitem),
    c AS (SELECT doc_id, 'section: Order ' || doc_id || ' caption: Lines columns: line | part | quantity | flag ' || string_agg('row ' || i || ': line=' || l_linenumber || '; part=' || l_partkey || '; quantity=' || l_quantity::INT || '; flag=' || l_returnflag, ' ' ORDER BY i) AS said, list_filter(flatten(list([l_linenumber::VARCHAR, l_partkey::VARCHAR, l_quantity::INT::VARCHAR, l_returnflag] ORDER BY i)), lambda x: length(x) >= 2)[1:4] AS v FROM r GROUP BY 1),
    d AS (SELECT doc_id, said, list_filter(v, lambda x, i: list_position(v, x) = i) AS v FROM c)
    SELECT doc_id, 'chunk-1' AS id, CASE WHEN len(v) > 0 THEN 'Lines 표 내용을 다룹니다: ' || array_to_string(v, ' / ') ELSE said END AS summary, 'Lines 표에는 어떤 항목이 포함되어 있나요?' AS question, 'heuristic' AS method FROM d"""
ORACLES["text_enrichment"] = """WITH f AS (SELECT doc_id, text, trim(regexp_replace(text, '[\\t-\\r ]+', ' ', 'g')) AS flat, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\t-\\r ]+', ' ', 'g'))), lambda x: x <> '')[1] AS top FROM documents),
    s AS (SELECT *, CASE WHEN regexp_matches(flat, '[.!?。！？] ') THEN regexp_extract(flat, '^(.*?[.!?。！？]) ', 1) ELSE flat END AS s, CASE WHEN top IS NULL THEN '이 내용' WHEN length(top) <= 80 THEN top ELSE rtrim(left(top, 79)) || '…' END AS topic, regexp_extract_all(text, '[0-9A-Za-z가-힣]{2,}') AS w FROM f)
    SELECT doc_id, CASE WHEN length(s) <= 300 THEN s ELSE rtrim(left(s, 299)) || '…' END AS summary, array_to_string(list_slice(list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: lower(x) NOT IN ('table', 'rows', 'columns', 'context', 'row', 'col', 'chunk')), 1, 8), ' ') AS keywords, topic || '의 핵심 내용은 무엇인가요?' AS question FROM s"""
#: Every table above the budget is cut, and every row of it is in one piece.
ORACLES["table_splits"] = f"""WITH r AS ({_ORDER_ROWS}), t AS (SELECT doc_id, count(*) AS n, 'section: Order ' || doc_id || ' caption: Lines columns: line | part | quantity | flag ' ||
    string_agg('row ' || row_index || ': line=' || l_linenumber || '; part=' || l_partkey || '; quantity=' || l_quantity::INT || '; flag=' || l_returnflag, ' ' ORDER BY row_index) AS line FROM r GROUP BY 1)
    SELECT doc_id, n AS rows_cut FROM t WHERE {_TOKENS} > 80 AND n > 1"""
ORACLES["question_tables"] = synthetic.grouped_sql(ORACLES["question_tables"])
