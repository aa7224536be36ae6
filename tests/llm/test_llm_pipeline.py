"""The stages of the pipeline one by one, each held against a plain version on its own input."""

import collections

import corpus_pipeline
import numpy as np
from corpus import clashing, lower, rows, words
from test_llm_operators import plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs.toPandas())
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        if at < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    raw, good, single, lone, mixed = inputs
    failed = 0
    for text in raw.text:
        own = words(text)
        windows = collections.Counter(tuple(own[k : k + 3]) for k in range(len(own) - 2))
        covered = {k + d for k in range(len(own) - 2) if windows[tuple(own[k : k + 3])] > 1 for d in range(3)}
        failed += len(own) < 50 or 100 * len(covered) > 50 * len(own)
    assert 0.95 * (len(raw) - failed) <= len(good) <= len(raw) - failed
    best = {}
    for r in good.itertuples():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert sorted(single.doc_id) == sorted(best.values())
    value = np.array([plain_fingerprint(t) for t in single.text], np.uint64)
    near, label = np.bitwise_count(value[:, None] ^ value[None, :]) <= 2, single.doc_id.to_numpy()
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    assert sorted(lone.doc_id) == sorted(set(label.tolist()))
    text, counts = dict(zip(lone.doc_id, lone.text)), collections.Counter()
    for r in mixed.itertuples():
        assert r.text in text[r.doc_id]
        counts[r.doc_id] += len(words(r.text))
    assert all(n <= 2 * len(words(text[i])) for i, n in counts.items())
    total = sum(len(words(t)) for t in lone.text)
    assert abs(sum(counts.values()) / total - 1.5) < 0.05
    pieces = docs.toPandas()
    used = pieces.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and all(x & (x - 1) == 0 for x in used)


def test_run_has_the_rows_of_its_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.count() > 0


def test_stages_over_hard_rows_and_none(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, further columns of clashing names; and a table without rows."""
    made = rows()
    frame = clashing(spark, made)
    for name, docs in (("hard", frame), ("empty", frame.limit(0))):
        columns = docs.columns
        for at, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}{at}")
            before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}{at}")
            if at < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns, stage_name
            if name == "empty":
                assert docs.count() == 0
            elif at < 3:  # nothing is made up, and what stays is unchanged
                assert docs.exceptAll(before).count() == 0
            if at == 0 and name == "hard":
                docs = frame  # few of these pass the quality rules; the others are for the next stages
        if name == "hard":
            assert docs.count() > 0
