"""Sizes, samples and duplicate files of the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import sampling


def _listing(spark, sf_dir):
    key = F.concat(F.col("source"), F.lit("/"), F.when(F.col("doc_id") % 7 == 0, F.lit("본문_")).otherwise(F.lit("doc_")), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".hwpx"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(key.alias("key"), (F.col("n_chars") * 40).alias("size"), "text")


def size_distribution(spark, sf_dir):
    return sampling.size_distribution(_listing(spark, sf_dir))


def size_bands(spark, sf_dir):
    rows = _listing(spark, sf_dir).select(sampling.band(F.col("size")).alias("band"), "size")
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def near_quantiles(spark, sf_dir):
    return sampling.near_quantiles(_listing(spark, sf_dir))


def size_buckets(spark, sf_dir):
    return sampling.size_buckets(_listing(spark, sf_dir), 15)


def file_listing(spark, sf_dir):
    rows = _listing(spark, sf_dir)
    line = F.when(F.col("size") % 7 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(F.when(F.col("size") % 11 == 0, F.lit("folder")).otherwise(F.lit("file")).alias("type"), "key", "size")))
    return sampling.listing(rows.select(line.alias("line")), ".hwpx").select("key", "size")


def duplicate_files(spark, sf_dir):
    rows = _listing(spark, sf_dir).select("key", F.sha2("text", 256).alias("sha256"))
    return rows.groupBy("sha256").agg(F.count("*").alias("n"), F.min("key").alias("kept")).where("n > 1")


def unique_samples(spark, sf_dir):
    rows = _listing(spark, sf_dir)
    made = sampling.size_buckets(rows, 60).join(rows.select("key", F.sha2("text", 256).alias("sha256")), "key")
    return sampling.unique_content(made, 20)


def diversified(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.concat(F.lit("g"), F.col("p_size"), F.lit("/"), F.col("p_name"), F.lit("_"), F.col("p_partkey"), F.lit(".hwpx"))
    return sampling.diversified(parts.select(key.alias("key"), F.col("p_partkey").alias("at")), [F.col("at")])


QUERIES = {f.__name__: f for f in (size_distribution, size_bands, near_quantiles, size_buckets, file_listing, duplicate_files, unique_samples, diversified)}

_L = "SELECT source || '/' || CASE WHEN doc_id % 7 = 0 THEN '본문_' ELSE 'doc_' END || lpad(doc_id::VARCHAR, 8, '0') || '.hwpx' AS key, n_chars * 40 AS size, doc_id, text FROM documents"
_BAND = "CASE WHEN size > 0 AND size <= 102400 THEN 'small' WHEN size > 102400 AND size <= 524288 THEN 'medium' WHEN size > 524288 AND size <= 2097152 THEN 'large' WHEN size > 2097152 AND size <= 20971520 THEN 'xlarge' WHEN size > 20971520 THEN 'outlier' END"
ORACLES = {
    "size_distribution": f"""WITH l AS ({_L}), r AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS n FROM l),
        m(name, q) AS (VALUES ('min', 0.0), ('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('p90', 0.9), ('max', 1.0))
        SELECT name, size FROM m JOIN r ON i = round_even((n - 1) * q, 0)""",
    "diversified": """WITH RECURSIVE r AS (SELECT 'g' || p_size || '/' || p_name || '_' || p_partkey || '.hwpx' AS key, 'g' || p_size AS folder, lower(p_name) AS family, row_number() OVER (ORDER BY p_partkey) AS i FROM part),
        g AS (SELECT 0::BIGINT AS i, ['']::VARCHAR[] AS folders, ['']::VARCHAR[] AS families, false AS fresh
        UNION ALL SELECT r.i, CASE WHEN list_contains(folders, folder) OR list_contains(families, family) THEN folders ELSE list_append(folders, folder) END, CASE WHEN list_contains(folders, folder) OR list_contains(families, family) THEN families ELSE list_append(families, family) END,
        NOT (list_contains(folders, folder) OR list_contains(families, family)) FROM g JOIN r ON r.i = g.i + 1),
        f AS (SELECT r.*, g.fresh FROM r JOIN g ON r.i = g.i), n AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY i) AS k, bool_or(fresh) OVER (PARTITION BY family) AS seen FROM f),
        p AS (SELECT *, CASE WHEN fresh THEN 1 WHEN NOT seen AND k = 1 THEN 2 ELSE 3 END AS pass FROM n) SELECT key, pass, (row_number() OVER (PARTITION BY pass ORDER BY i))::INT AS pos FROM p""",
    "size_bands": f"WITH l AS ({_L}) SELECT {_BAND} AS band, count(*) AS n, sum(size)::BIGINT AS bytes FROM l GROUP BY 1",
    "near_quantiles": f"""WITH l AS (SELECT *, {_BAND} AS band FROM ({_L})), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY size, key) - 1 AS i, count(*) OVER (PARTITION BY band) AS n FROM l WHERE band <> 'outlier'),
        m(q, v) AS (VALUES (1, 0.1), (2, 0.3), (3, 0.5), (4, 0.7), (5, 0.9)),
        c AS (SELECT band, q::INT AS q, key, size, row_number() OVER (PARTITION BY band, q ORDER BY doc_id % 7 = 0, abs(i - round_even((n - 1) * v, 0)), key) AS k FROM r JOIN m ON abs(i - round_even((n - 1) * v, 0)) <= 15)
        SELECT band, q, key, size FROM c WHERE k = 1""",
    "size_buckets": f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY size, key) - 1 AS i, count(*) OVER () AS n FROM ({_L}))
        SELECT 'small' AS bucket, i + 1 AS place, key, size FROM r WHERE i < 15
        UNION ALL SELECT 'medium', i - (n - 15) // 2 + 1, key, size FROM r WHERE i >= (n - 15) // 2 AND i < (n - 15) // 2 + 15
        UNION ALL SELECT 'large', n - i, key, size FROM r WHERE i >= n - 15""",
    "file_listing": f"SELECT key, size FROM ({_L}) WHERE size % 7 <> 0 AND size % 11 <> 0",
    "duplicate_files": f"SELECT sha256(text) AS sha256, count(*) AS n, min(key) AS kept FROM ({_L}) GROUP BY 1 HAVING count(*) > 1",
    "unique_samples": f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY size, key) - 1 AS i, count(*) OVER () AS n FROM ({_L})),
        b AS (SELECT 'small' AS bucket, i + 1 AS place, key, text FROM r WHERE i < 60 UNION ALL SELECT 'medium', i - (n - 60) // 2 + 1, key, text FROM r WHERE i >= (n - 60) // 2 AND i < (n - 60) // 2 + 60 UNION ALL SELECT 'large', n - i, key, text FROM r WHERE i >= n - 60),
        d AS (SELECT bucket, place, key, sha256(text) AS sha256, row_number() OVER (PARTITION BY text ORDER BY bucket, place) AS k FROM b),
        e AS (SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY place)::INT AS n, key, sha256 FROM d WHERE k = 1) SELECT * FROM e WHERE n <= 20""",
}
