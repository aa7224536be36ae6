"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Features of a text are its words, A-Z lower-cased, and their first four, five
and six bytes, so that forms of one stem meet.  Every feature of the labelled
examples counts, but for those of fewer than ``least_rows`` examples and
stop words, which more than ``most_share`` of them have.  A feature weighs its
inverse document frequency; one that goes with either label so much oftener
that, by the likelihood ratio, chance would not give one such among all that
were looked at, weighs ``sharpened`` times that and is never a stop word.

An inverted index holds the vectors of all examples, of both labels: the
postings of a feature, cut into blocks of examples, each block with its
greatest weight.  A query adds up these maxima by block, looks into blocks
from the most promising on, and stops at the first whose bound is below the
k-th best cosine found; the neighbours are exact.

Neighbours vote for their label with the weight of their closeness.  A vote
becomes a score by the share of the label among training examples of like
votes, made monotone (pool adjacent violators), each example having voted
without itself.  The ids of the nearest three are the evidence.  A text
without any feature gets the share among such examples and has no evidence.

The model is fitted on at most ``sample`` labelled rows, chosen by a hash of
their ids; of rows that share an id one is learned from, that with the least
hash of its text.  This bounds the vectors and features that are sent to the
tasks.  All texts are scored whole, in one scan without a shuffle.  Null and
empty texts have no feature.  Null labels and ids are not learned from; a row
labelled twice is toxic if one label says so.  Repeated rows are each scored.
Without any label every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._arrow import LOWER, Texts, Words, column, ranges, slices, span_hashes
from docweave.llm._spark import written


@dataclass(frozen=True)
class Fit:
    sample: int = 4_096
    least_rows: int = 3
    most_share: float = 0.05
    sharpened: float = 4.0
    margin: float = 3.0  # nats beyond the logarithm of the number of features looked at
    neighbours: int = 16
    block: int = 128
    prefixes: tuple[int, ...] = (4, 5, 6)


def text_features(texts: Texts, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word's features."""
    words = Words(texts)
    data, doc = LOWER[texts.data], words.doc()
    hashes = [span_hashes(data, words.starts, words.ends)]
    docs = [doc]
    for n in prefixes:
        longer = words.ends - words.starts > n
        starts = words.starts[longer]
        hashes.append(span_hashes(data, starts, starts + n) ^ np.uint64(n))
        docs.append(doc[longer])
    return np.concatenate(hashes), np.concatenate(docs)


class Vocabulary:
    """The features: their hashes, ordered, their weights, and which of them go with a label."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray, telling: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.idf, self.telling = hashes[order], idf[order], telling[order]
        self.first = np.zeros(1 << 16, bool)  # by leading bits: spares most words the search
        self.first[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def vectors(self, texts: Texts, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature and unit-length TF-IDF weight of the non-zero entries, by text."""
        hashes, doc = text_features(texts, prefixes)
        maybe = self.first[(hashes >> np.uint64(48)).astype(np.int64)] if len(self.hashes) else np.zeros(len(hashes), bool)
        hashes, doc = hashes[maybe], doc[maybe]
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(0, bool)
        key, count = np.unique(doc[known] * len(self.hashes) + at[known], return_counts=True)
        row, feature = np.divmod(key, max(1, len(self.hashes)))
        weight = (1 + np.log(count)) * self.idf[feature]
        norm = np.sqrt(np.bincount(row, weight**2, texts.n))
        return row, feature, weight / norm[row] if len(row) else weight


class Index:
    """A block-max inverted index of unit vectors."""

    def __init__(self, rows: np.ndarray, features: np.ndarray, weights: np.ndarray, n_rows: int, n_features: int, block: int):
        order = np.lexsort((rows, features))
        self.rows, self.weights, self.block, self.n_rows = rows[order].astype(np.int32), weights[order], block, n_rows
        self.starts = np.searchsorted(features[order], np.arange(n_features + 1))
        self.blocks = -(-n_rows // block)
        key = features[order] * max(1, self.blocks) + self.rows // block
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.block_begin = np.append(head, len(key))
        self.block_of = self.rows[head] // block
        self.block_max = np.maximum.reduceat(self.weights, head) if len(head) else np.empty(0)
        self.block_starts = np.searchsorted(features[order][head], np.arange(n_features + 1))

    def nearest(self, features: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of greatest cosine above 0 with their cosines, equal ones by row."""
        low, high = self.block_starts[features], self.block_starts[features + 1]
        lists = ranges(low, high - low)
        if not len(lists):
            return np.empty(0, np.int64), np.empty(0)
        factor, of = np.repeat(weights, high - low), self.block_of[lists]
        bound = np.bincount(of, self.block_max[lists] * factor, self.blocks)
        some = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound)]
        best_rows, best = np.empty(0, np.int64), np.empty(0)
        at, width = 0, 2
        while at < len(some):
            if len(best) == k:  # what is left must be able to beat the k-th
                width = int(np.searchsorted(-bound[some[at:]], -(best[-1] - 1e-12), "right"))
                if not width:
                    break
            inside = np.zeros(self.blocks, bool)
            inside[some[at : at + width]] = True
            at, width = at + width, width * 4
            picked = np.flatnonzero(inside[of])
            begin = self.block_begin[lists[picked]]
            counts = self.block_begin[lists[picked] + 1] - begin
            where = ranges(begin, counts)
            cosine = np.bincount(self.rows[where], self.weights[where] * np.repeat(factor[picked], counts))
            rows = np.flatnonzero(cosine)
            rows = rows[rows != without]
            best_rows, best = np.concatenate([best_rows, rows]), np.concatenate([best, cosine[rows]])
            order = np.lexsort((best_rows, -np.round(best, 12)))[:k]
            best_rows, best = best_rows[order], best[order]
        return best_rows, best


def vote(cosine: np.ndarray, labels: np.ndarray) -> float:
    """The neighbours' share of the label, each weighing by its closeness."""
    weight = 1 / (1.05 - np.minimum(cosine, 1.0))
    return float((weight * labels).sum() / weight.sum())


def monotone(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean votes of pools of like votes, and the share of the label in each, never falling."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # greatest vote, sum of votes, labels, rows
    for v, y in zip(votes[order].tolist(), labels[order].tolist()):
        pools.append([v, v, float(y), 1.0])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]):
            top, total, y2, n2 = pools.pop()
            pools[-1] = [top, pools[-1][1] + total, pools[-1][2] + y2, pools[-1][3] + n2]
    # Half of one imagined tenth of a row has the label.
    return np.array([p[1] / p[3] for p in pools]), np.maximum.accumulate([(p[2] + 0.05) / (p[3] + 0.1) for p in pools])


class Model:
    """The examples that have a feature, ordered so that like ones share blocks, and what votes are worth."""

    def __init__(self, vocabulary: Vocabulary, rows, features, weights, ids: list, labels: np.ndarray, fit: Fit):
        self.vocabulary, self.fit = vocabulary, fit
        filled, row = np.unique(rows, return_inverse=True)
        rest = np.delete(labels, filled)
        self.blank = float(rest.mean()) if len(rest) else float(labels.mean()) if len(labels) else 0.0
        heaviest = np.lexsort((-weights, row))  # by row its greatest weight first
        lead = features[heaviest[np.searchsorted(row[heaviest], np.arange(len(filled)))]] if len(filled) else filled
        order = np.lexsort((filled, lead))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.labels = [ids[i] for i in filled[order]], labels[filled[order]]
        self.place = {x: i for i, x in enumerate(self.ids)}
        self.index = Index(place[row], features, weights, len(filled), len(vocabulary.hashes), fit.block)
        self.calibrate(np.empty(0), np.empty(0))

    def calibrate(self, votes: np.ndarray, truth: np.ndarray) -> None:
        self.knots, self.shares = monotone(votes, truth) if len(votes) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def vote(self, features: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[float | None, list]:
        """The vote on a vector, and the ids of the neighbours behind it, nearest first."""
        near, cosine = self.index.nearest(features, weights, self.fit.neighbours, without)
        return (vote(cosine, self.labels[near]), [self.ids[i] for i in near]) if len(near) else (None, [])

    def score(self, features: np.ndarray, weights: np.ndarray) -> tuple[float, list]:
        v, near = self.vote(features, weights)
        return (self.blank, []) if v is None else (float(np.interp(v, self.knots, self.shares)), near[:3])


def fold(doc_id, n: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def telling(a: np.ndarray, n: np.ndarray, share: float, margin: float) -> np.ndarray:
    """Of features that n rows have, a of them toxic: whose rows have the label, or lack it, more often than chance lets one of so many features do."""
    if not 0 < share < 1:
        return np.zeros(len(n), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(a > 0, a * np.log(a / (n * share)), 0.0) + np.where(n > a, (n - a) * np.log((n - a) / (n * (1 - share))), 0.0)
    return gain >= np.log(max(1, len(n))) + margin


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """The model of the labels (doc_id, toxic) for docs (doc_id, text); both without rows that must not be learned from."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.sample)
    # The chosen ids are at most fit.sample rows of two numbers.
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), "id")
    sample = written(rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    prefixes = fit.prefixes

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, doc = text_features(Texts(column(part, "text")), prefixes)
            label = column(part, "label").to_numpy()
            keys = np.unique(np.stack([doc.astype(np.uint64), hashes]), axis=1) if len(doc) else np.empty((2, 0), np.uint64)
            toxic = label[keys[0].astype(np.int64)] == 1
            found, inverse = np.unique(keys[1], return_inverse=True)
            a, n = np.bincount(inverse, toxic, len(found)), np.bincount(inverse, minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(a.astype(np.int64)), pa.array(n.astype(np.int64))], names=["h", "a", "n"])

    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = sample.mapInArrow(present, "h long, a long, n long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    table = counts.where(F.col("n") >= fit.least_rows).toArrow()
    h, a, n = (table.column(c).to_numpy() for c in ("h", "a", "n"))
    tells = telling(a, n, toxic / max(1, total), fit.margin)
    stays = tells | (n <= max(fit.least_rows, fit.most_share * total))
    h, n, tells = h[stays], n[stays], tells[stays]
    idf = (np.log((1 + total) / (1 + n)) + 0.1) * np.where(tells, fit.sharpened, 1.0)
    vocabulary = Vocabulary(h.view(np.uint64), idf, tells)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as many features as the sample has

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            row, feature, weight = sent.value.vectors(Texts(column(part, "text")), prefixes)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            packed = [[x[i:j].tobytes() for i, j in zip(cut, cut[1:])] for x in (feature.astype(np.int32), weight)]
            yield pa.RecordBatch.from_arrays([column(part, "id"), column(part, "label"), *(pa.array(x, pa.binary()) for x in packed)], names=["id", "label", "features", "weights"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("id", "label", "text").mapInArrow(vectors, f"id {kind}, label int, features binary, weights binary").collect()
    rows.sort(key=lambda r: r[0])
    features, weights = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in ((2, np.int32), (3, np.float64)))
    model = Model(vocabulary, np.repeat(np.arange(len(rows)), [len(r[2]) // 4 for r in rows]), features.astype(np.int64), weights, [r[0] for r in rows], np.array([r[1] for r in rows], float), fit)
    whole = docs.sparkSession.sparkContext.broadcast(model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = whole.value
        for part in slices(batches, "text"):
            found = [model.vote(f, w, model.place.get(i, -1))[0] for i, (f, w) in zip(column(part, "id").to_pylist(), _each(model, part))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), column(part, "label")], names=["vote", "label"])

    voted = sample.select("id", "label", "text").repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(votes, "vote double, label int").where("vote is not null").toArrow()
    model.calibrate(voted.column("vote").to_numpy(), voted.column("label").to_numpy())
    return model


def _each(model: Model, part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The features and weights of each text of a batch."""
    row, feature, weight = model.vocabulary.vectors(Texts(column(part, "text")), model.fit.prefixes)
    cut = np.searchsorted(row, np.arange(part.num_rows + 1))
    for i, j in zip(cut, cut[1:]):
        yield feature[i:j], weight[i:j]


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, score, predicted, evidence (ids of the nearest examples)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as the sample
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in slices(batches, "text"):
            found = [model.score(*x) for x in _each(model, part)]
            score = np.array([x for x, _ in found])
            evidence = [",".join(map(str, near)) for _, near in found]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(evidence, pa.string())], names=["doc_id", "score", "predicted", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double, predicted int, evidence string")


def toxicity(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence; learns from no row whose crc32 of the id modulo 4 is 2."""
    own = docs.select("doc_id", "text")
    learned = labels.select("doc_id", "toxic").where(fold(F.col("doc_id"), 4) != 2)
    rows = scored(own, fitted(own, learned, fit))
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
