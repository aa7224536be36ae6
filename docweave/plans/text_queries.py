"""Scalar text rules over documents and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as t
from docweave.sources.spread import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def token_estimate(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", t.estimated_tokens(F.col("text")).alias("tokens"))


def keywords(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", F.array_join(t.keywords(text), " ").alias("keywords"), F.array_join(t.keywords_without_stops(text), " ").alias("keywords_kept"))


def first_sentence(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", t.first_sentence(F.col("text")).alias("summary"))


def text_previews(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", t.normalize_space(text).alias("flat"), t.clipped(text, 90).alias("preview"), t.clipped_clean(text, 60).alias("clean_preview"), t.flat_summary(text).alias("summary"), t.first_line(text, 100).alias("title"), t.topic(text).alias("topic"))


def fallback_questions(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", t.question_about(F.left(text, F.lit(80))).alias("question"), t.clean_question(text).alias("cleaned"))


_NAMES = "concat('group', p_size, '/', p_name, '(', p_brand, ') [x] 제 2020 - ', p_partkey, ' 호_', p_type, '+2021-03-1', p_partkey % 10, '.hwpx')"


def file_families(spark, sf_dir):
    key = F.expr(_NAMES)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", t.file_family(key).alias("family"), F.split(key, "/")[0].alias("file_group"), t.safe_id(key).alias("safe_id"), F.sha1(key).alias("prefix"))


def heading_rules(spark, sf_dir):
    made = F.element_at(F.array(F.concat(F.col("p_size"), F.lit(". "), F.col("p_name")), F.concat(F.lit("가. "), F.col("p_type")), F.concat(F.lit("[별지 제"), F.col("p_size"), F.lit("호 서식] "), F.col("p_name")), F.concat(F.lit("[별지 제3호서식] <삭 제 "), F.col("p_size"), F.lit(">")), F.concat(F.lit("○ 사례 "), F.col("p_size"), F.lit(": "), F.col("p_name")), F.concat(F.lit("210mm×297mm(일반용지 60g/㎡) "), F.col("p_brand")), F.lit("(뒤 쪽)"), F.col("p_name")), (F.col("p_partkey") % 8 + 1).cast("int"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", made.alias("made"))
    c = F.col("made")
    flags = {"heading": t.looks_like_heading(c), "deleted": t.is_deleted_form(c), "form_heading": t.is_form_heading(c), "new_form": t.starts_form(c), "new_case": t.starts_case(c), "form_end": t.ends_form(c), "back_page": t.is_back_page(c)}
    return parts.select("p_partkey", *(v.cast("int").alias(k) for k, v in flags.items()))


def public_urls(spark, sf_dir):
    uri = F.concat(F.lit("s3://evidence/run 1/"), F.col("p_name"), F.lit("/ä#"), F.col("p_partkey"), F.lit(".png"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", t.public_url(uri, "https://store.example/base/").alias("url"))


def event_payloads(spark, sf_dir):
    """Tolerant JSON: a payload inside other text parses as it does alone."""
    wrapped = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("answer: "), F.col("props"), F.lit(" (end)"))).otherwise(F.lit("no payload"))
    parsed = t.loose_json(wrapped)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", parsed.isNotNull().cast("int").alias("parsed"), F.when(parsed.isNotNull(), F.length("props")).otherwise(0).alias("n"))


QUERIES = {f.__name__: f for f in (token_estimate, keywords, first_sentence, text_previews, fallback_questions, file_families, heading_rules, public_urls, event_payloads)}

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_WORDS = "regexp_extract_all(text, '[0-9A-Za-z가-힣]{2,}')"
_FORM = r"[\[(][^\])]*별지\s*(제\s*)?[0-9]{1,9}([‐‑–—-][0-9]{1,9})?\s*호(\s*서식)?[^\])]*[\])]"

ORACLES = {
    "token_estimate": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]{1,4}|[^\s\x0bA-Za-z0-9_]'))::BIGINT AS tokens FROM documents",
    "keywords": f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w), f AS (SELECT doc_id, word, min(i) AS i FROM u GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
        s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f WHERE lower(word) NOT IN ('table', 'rows', 'columns', 'context', 'row', 'col', 'chunk'))
        SELECT doc_id, coalesce((SELECT string_agg(word, ' ' ORDER BY k) FROM r WHERE r.doc_id = w.doc_id AND k <= 8), '') AS keywords,
        coalesce((SELECT string_agg(word, ' ' ORDER BY k) FROM s WHERE s.doc_id = w.doc_id AND k <= 8), '') AS keywords_kept FROM w""",
    "first_sentence": f"""WITH f AS (SELECT doc_id, {_flat('text')} AS flat FROM documents),
        s AS (SELECT doc_id, CASE WHEN regexp_matches(flat, '[.!?。！？] ') THEN regexp_extract(flat, '^(.*?[.!?。！？]) ', 1) ELSE flat END AS s FROM f)
        SELECT doc_id, CASE WHEN length(s) <= 300 THEN s ELSE rtrim(left(s, 299)) || '…' END AS summary FROM s""",
    "text_previews": f"""WITH b AS (SELECT doc_id, text, {_stripped('text')} AS bare FROM documents),
        l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_stripped('x')}), lambda x: x <> '') AS ls FROM b),
        m AS (SELECT *, {_flat('ls[1]')} AS top FROM l)
        SELECT doc_id, {_flat('text')} AS flat, CASE WHEN length(bare) <= 90 THEN bare ELSE left(bare, 89) || '…' END AS preview,
        CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(left(text, 59), '{_WS}+$', '') || '…' END AS clean_preview,
        left(replace(bare, chr(10), ' '), 500) AS summary, coalesce(left(ls[1], 100), '') AS title,
        coalesce(CASE WHEN length(top) <= 80 THEN top ELSE rtrim(left(top, 79)) || '…' END, '') AS topic FROM m""",
    "fallback_questions": f"""WITH b AS (SELECT doc_id, {_stripped('left(text, 80)')} AS base, {_flat('text')} AS flat FROM documents)
        SELECT doc_id, CASE WHEN base = '' THEN '이 청크' ELSE base END || '에 대해 무엇을 알 수 있나요?' AS question,
        CASE WHEN flat = '' OR right(flat, 1) IN ('?', '？') THEN flat ELSE rtrim(flat, '.。') || '?' END AS cleaned FROM b""",
    "file_families": f"""WITH k AS (SELECT p_partkey, {_NAMES} AS key FROM part),
        a AS (SELECT *, translate(replace(string_split(key, '/')[-1], '.hwpx', ''), '+_', '  ') AS n FROM k),
        b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(n, '\\([^)]*\\)', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g'), '제\\s*[0-9]{{4}}\\s*-\\s*[0-9]+\\s*호', ' ', 'g') AS m FROM a),
        c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(m, '[0-9]{{4}}[.-][0-9]{{1,2}}[.-][0-9]{{1,2}}', ' ', 'g'), '[0-9]+', ' ', 'g'), '[-¸,.;:]+', ' ', 'g') AS o FROM b)
        SELECT p_partkey, lower(trim(regexp_replace(o, '\\s+', ' ', 'g'))) AS family, string_split(key, '/')[1] AS file_group,
        left(regexp_replace(key, '[^A-Za-z0-9._-]+', '-', 'g'), 120) AS safe_id, sha1(key) AS prefix FROM c""",
    "heading_rules": f"""WITH m AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size || '. ' || p_name WHEN 1 THEN '가. ' || p_type WHEN 2 THEN '[별지 제' || p_size || '호 서식] ' || p_name
        WHEN 3 THEN '[별지 제3호서식] <삭 제 ' || p_size || '>' WHEN 4 THEN '○ 사례 ' || p_size || ': ' || p_name WHEN 5 THEN '210mm×297mm(일반용지 60g/㎡) ' || p_brand WHEN 6 THEN '(뒤 쪽)' ELSE p_name END AS x FROM part)
        SELECT p_partkey, (length(x) <= 120 AND (regexp_matches(x, '^[0-9]{{1,2}}\\.\\s+\\S') OR regexp_matches(x, '^[가-힣]\\.\\s+\\S') OR regexp_matches(x, '^{_FORM}\\s*$') OR regexp_matches(x, '^{_FORM}\\s*[^.?!]{{1,60}}$')))::INT AS heading,
        regexp_matches(x, '^{_FORM}\\s*<[^>]*삭\\s*제[^>]*>$')::INT AS deleted, (regexp_matches(x, '^{_FORM}') AND length(x) <= 120)::INT AS form_heading,
        (x <> '(뒤 쪽)' AND regexp_matches(left(x, 300), '{_FORM}'))::INT AS new_form, regexp_matches(x, '^[○●]?\\s*사례\\s*[0-9]+([^0-9]|$)')::INT AS new_case,
        (x LIKE '210mm%')::INT AS form_end, (x = '(뒤 쪽)')::INT AS back_page FROM m""",
    "public_urls": "SELECT p_partkey, 'https://store.example/base/evidence/run%201/' || url_encode(p_name) || '/%C3%A4%23' || p_partkey || '.png' AS url FROM part",
    "event_payloads": "SELECT event_id, (event_id % 3 < 2)::INT AS parsed, CASE WHEN event_id % 3 < 2 THEN length(props)::INT ELSE 0 END AS n FROM events",
}
