"""Language-model scores by deleted interpolation.

A token's probability given the one before it is a mixture of maximum-
likelihood estimates: of the pair, of the token alone, and one part for all
unseen tokens.  How they mix depends on how often the context was seen, in
buckets by powers of two.  The weights are learned by expectation-
maximisation on held-out counts: every occurrence in the training texts is
scored by the counts of all the others, itself deleted.

Counts are never gathered in one place:

1.  Texts become chunks of about ``chunk_tokens`` tokens: the distinct words
    (64-bit hashes) and, for each token, the word's number.  Chunks are
    written once, packed, so whatever order rows come in when the input is
    read again does not matter.
2.  A chunk asks for the counts of its distinct words and pairs.  A request
    is a sorted list of hashes with the chunk's own counts, cut by ranges of
    hashes; a range has one owner task, which adds up what all chunks have
    and answers each in the order of its request.  A word that makes up a
    third of all tokens is one entry per chunk.  Beyond ``fan`` owners,
    chunks ask in groups: the requests of a group for one of about sqrt(owners)
    wider ranges are merged, asked once, and the answers handed back.  So the
    number of requests grows with the chunks times the square root of the
    owners, and each stays thousands of entries long.
3.  Answers meet their chunk, which then knows the counts behind each token.
    These are written, with a histogram of the deleted counts whose cells
    (two for each doubling of a count) bound its size.
4.  The driver learns the weights from the summed histogram; every chunk is
    scored with them.

Words are maximal runs without white space, A-Z lower-cased; one end token
closes a text and is the context of the next one's first word.  Null and
empty texts are an end token.  Rows with a null id are never training rows.
Repeated rows count and are scored each.  Without training rows the unseen
part, one token, has all probability, and every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._arrow import Texts, Words, column, pair, slices
from docweave.llm._spark import written

END_HASH = np.uint64(0x5EED0FE2D0C5A11D)
#: Pairs are known by 56 bits of their hash, words by 64.
PAIR_BITS = np.uint64(0xFFFFFFFFFFFFFF00)


@dataclass(frozen=True)
class Interpolation:
    chunk_tokens: int = 1 << 21
    owner_bytes: int = 24 << 20  # of text for each owner of counts
    rounds: int = 60
    buckets: int = 40
    fan: int = 4096


def squeezed(values: np.ndarray) -> bytes:
    """An integer array in few bytes."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def restored(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def squeezed_sorted(values: np.ndarray) -> bytes:
    return squeezed(np.diff(values, prepend=np.uint64(0)))


def restored_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(restored(blob, np.uint64), dtype=np.uint64)


def level(count: np.ndarray) -> np.ndarray:
    """The histogram's cell of a count: exact below four, then two for each doubling."""
    return np.where(count < 4, count, np.floor(2 * np.log2(np.maximum(count, 1)) + 1e-9)).astype(np.int64)


def middle(cell: np.ndarray) -> np.ndarray:
    return np.where(cell < 4, cell, 2.0 ** ((cell + 0.5) / 2))


class _Chunk:
    """Tokens of some texts by word number, and what to ask for."""

    def __init__(self, vocabulary: np.ndarray, index: np.ndarray, lengths: np.ndarray, train: np.ndarray):
        self.vocabulary, self.index = vocabulary, index  # sorted hashes; a word number per token
        self.lengths, self.trained = lengths, np.repeat(train, lengths)
        self.end = int(np.searchsorted(vocabulary, END_HASH))

    @cached_property
    def before(self) -> np.ndarray:
        """The word before each token; each text but the first follows an end token."""
        return np.concatenate([np.array([self.end], self.index.dtype), self.index[:-1]])

    @cached_property
    def _paired(self) -> tuple[np.ndarray, np.ndarray]:
        codes, distinct = pd.factorize(pair(self.vocabulary[self.before], self.vocabulary[self.index]) & PAIR_BITS)
        order = np.argsort(distinct)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        return distinct[order], place[codes]

    @property
    def pairs(self) -> np.ndarray:
        """Sorted hashes of the distinct pairs."""
        return self._paired[0]

    @property
    def pair(self) -> np.ndarray:
        """A pair number per token."""
        return self._paired[1]

    def requests(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted hashes and training counts of the words, then of the pairs."""
        for hashes, numbers in ((self.vocabulary, self.index), (self.pairs, self.pair)):
            yield hashes, np.bincount(numbers[self.trained], minlength=len(hashes)).astype(np.uint32)


def _ranges(hashes: np.ndarray, owners: int) -> np.ndarray:
    """Where the hashes of each owner begin, and the end."""
    of = ((hashes >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
    return np.searchsorted(of, np.arange(owners + 1, dtype=np.uint64))


def _chunked(batches: Iterator[pa.RecordBatch], settings: Interpolation) -> Iterator[tuple[int, pa.Array, _Chunk, np.ndarray]]:
    """Name, ids, content and training marks of each chunk of a task's rows (doc_id, text, train)."""
    place, number, tokens = TaskContext.get().partitionId(), 0, 0
    ids, train, lengths, hashes = [], [], [], []

    def chunk() -> tuple[int, pa.Array, _Chunk, np.ndarray]:
        codes, distinct = pd.factorize(np.concatenate(hashes))
        hashes.clear()
        order = np.argsort(distinct)
        place_of = np.empty(len(order), np.uint32)
        place_of[order] = np.arange(len(order))
        index, vocabulary, on = place_of[codes], distinct[order], np.concatenate(train)
        made = place << 32 | number, pa.concat_arrays(ids), _Chunk(vocabulary, index, np.concatenate(lengths), on), on
        for held in (ids, train, lengths):
            held.clear()
        return made

    for part in slices(batches, "text"):
        words = Words(Texts(column(part, "text")))
        n = part.num_rows
        of = np.empty(len(words.starts) + n, np.uint64)
        is_end = np.zeros(len(of), bool)
        is_end[words.of[1:] + np.arange(n)] = True
        of[is_end], of[~is_end] = END_HASH, words.hashes(lower=True)
        hashes.append(of)
        ids.append(column(part, "doc_id"))
        train.append(column(part, "train").to_numpy(zero_copy_only=False).astype(bool))
        lengths.append(words.counts + 1)
        tokens += len(of)
        if tokens >= settings.chunk_tokens:
            yield chunk()
            number, tokens = number + 1, 0
    if tokens:
        yield chunk()


def chunks(docs: DataFrame, settings: Interpolation) -> DataFrame:
    """Chunks of docs (doc_id, text, train) as rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, chunk, train in _chunked(batches, settings):
            values = [pa.array([name], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([train], pa.list_(pa.bool_())), pa.array([chunk.lengths], pa.list_(pa.int64())), pa.array([squeezed_sorted(chunk.vocabulary)], pa.binary()), pa.array([squeezed(chunk.index.astype(np.uint32))], pa.binary())]
            yield pa.RecordBatch.from_arrays(values, names=["chunk", "ids", "train", "lengths", "vocabulary", "tokens"])

    return docs.mapInArrow(apply, f"chunk long, ids array<{kind}>, train array<boolean>, lengths array<bigint>, vocabulary binary, tokens binary")


def _opened(batch: pa.RecordBatch, i: int) -> _Chunk:
    lengths, train = (np.array(column(batch, c)[i].as_py()) for c in ("lengths", "train"))
    return _Chunk(restored_sorted(column(batch, "vocabulary")[i].as_py()), restored(column(batch, "tokens")[i].as_py(), np.uint32), lengths, train)


ANSWER = ["chunk", "part", "owner", "counts"]


REQUEST = "chunk long, part int, owner int, hashes binary, counts binary"


def _request_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["chunk", "part", "owner", "hashes", "counts"])


def _cut(asker: int, part: int, hashes: np.ndarray, counts: np.ndarray, owners: int) -> list[tuple]:
    """The requests for sorted hashes, one for each owner of some."""
    cut = _ranges(hashes, owners)
    return [(asker, part, int(o), squeezed_sorted(hashes[cut[o] : cut[o + 1]]), squeezed(counts[cut[o] : cut[o + 1]].astype(np.uint64))) for o in np.flatnonzero(np.diff(cut))]


def requests(chunked: DataFrame, owners: int) -> DataFrame:
    """What each chunk asks: part (1: words, 2: pairs), owner, sorted hashes and their counts in the chunk."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(column(batch, "chunk").to_pylist()):
                for part, (hashes, counts) in enumerate(_opened(batch, i).requests(), 1):
                    yield _request_rows(_cut(name, part, hashes, counts, owners))

    return chunked.select("chunk", "train", "lengths", "vocabulary", "tokens").mapInArrow(ask, REQUEST)


def grouped_answers(asked: DataFrame, ranges: int, groups: int) -> DataFrame:
    """answers() of requests for wide ranges, asked by groups of chunks."""
    keys = ("group", "owner", "part")
    asked = asked.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    tasks = max(groups, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, owner, part), rows in _runs(batches, keys):
            hashes, codes = np.unique(np.concatenate([restored_sorted(r["hashes"]) for r in rows]), return_inverse=True)
            counts = np.bincount(codes, np.concatenate([restored(r["counts"], np.uint64) for r in rows]), len(hashes))
            yield _request_rows(_cut(group << 24 | owner, part, hashes, counts, ranges * ranges))

    def hand_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, owner, part), rows in _runs(batches, keys):
            requested = [(r["chunk"], restored_sorted(r["hashes"])) for r in rows if r["hashes"] is not None]
            known = np.unique(np.concatenate([h for _, h in requested]))
            cut = np.unique(_ranges(known, ranges * ranges))
            counts = np.concatenate([_counted(r["counts"], z - a) for r, a, z in zip((r for r in rows if r["hashes"] is None), cut, cut[1:])])
            made = [(chunk, part, owner, squeezed(counts[np.searchsorted(known, h)].astype(np.uint64))) for chunk, h in requested]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=ANSWER)

    merged = asked.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(merge, REQUEST)
    found = written(answers(merged, ranges * ranges))
    of = found.where("part != 3").select(F.shiftright("chunk", 24).alias("group"), F.col("chunk").bitwiseAND((1 << 24) - 1).cast("int").alias("owner"), "part", F.col("owner").alias("within"), F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("hashes"), "counts")
    both = asked.select("group", "owner", "part", F.lit(-1).alias("within"), "chunk", "hashes", F.lit(None).cast("binary").alias("counts")).union(of)
    back = both.repartition(tasks, *keys).sortWithinPartitions(*keys, "within").mapInArrow(hand_back, "chunk long, part int, owner int, counts binary")
    return back.union(found.where("part = 3"))


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow each other with the same keys."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != at and held:
                yield at, held
                held = []
            at = key
            held.append(row)
    if held:
        yield at, held


def answers(asked: DataFrame, owners: int) -> DataFrame:
    """For each request, by its chunk, part and owner, the counts of what was asked, in order; as part 3 of no chunk, each owner's tokens and distinct words."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked_of = None, []

        def row(chunk: int, part: int, counts: np.ndarray) -> tuple:
            return chunk, part, at[0], squeezed(counts)

        def answered() -> Iterator[pa.RecordBatch]:
            if not asked_of:
                return
            hashes = np.concatenate([h for _, h, _ in asked_of])
            codes, distinct = pd.factorize(hashes)
            total = np.bincount(codes, np.concatenate([c for _, _, c in asked_of]), len(distinct)).astype(np.uint64)
            each = total[codes]
            ends = np.cumsum([len(h) for _, h, _ in asked_of])
            rows = [row(chunk, at[1], each[z - len(h) : z].astype(np.uint32 if total.max() < 1 << 32 else np.uint64)) for (chunk, h, _), z in zip(asked_of, ends)]
            if at[1] == 1:
                rows.append((-1 - at[0], 3, at[0], squeezed(np.array([total.sum(), (total > 0).sum()], np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=ANSWER)
            asked_of.clear()

        for batch in batches:
            for chunk, part, owner, h, c in zip(*(column(batch, x).to_pylist() for x in ("chunk", "part", "owner", "hashes", "counts"))):
                if (owner, part) != at:
                    yield from answered()
                    at = (owner, part)
                asked_of.append((chunk, restored_sorted(h), restored(c, np.uint64)))
        yield from answered()

    routed = asked.repartition(owners, "owner").sortWithinPartitions("owner", "part")
    return routed.mapInArrow(answer, "chunk long, part int, owner int, counts binary")


def _counted(blob: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return restored(blob, np.uint32 if len(raw) == 4 * n else np.uint64).astype(np.int64)


def counted(chunked: DataFrame, answered: DataFrame, owners: int, tasks: int, kind: str) -> DataFrame:
    """Per chunk: its ids, training marks and lengths, by text the known tokens and the sum of log10(count + 1), by token the counts of the word and of the pair, and the histogram of deleted counts; and the owners' totals."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ids", f"array<{kind}>"), ("train", "array<boolean>"), ("lengths", "array<bigint>"), ("vocabulary", "binary"), ("tokens", "binary"))]
    both = chunked.select("chunk", F.lit(0).alias("part"), F.lit(0).alias("owner"), F.lit(None).cast("binary").alias("counts"), "ids", "train", "lengths", "vocabulary", "tokens").union(answered.select(*ANSWER, *none))
    names = ["ids", "train", "lengths", "known", "logs", "words", "pairs", "cells", "sizes", "totals"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, row, got = None, None, {1: [], 2: []}

        def resolved() -> pa.RecordBatch:
            words, pairs = (np.concatenate([_counted(b, z - a) for b, a, z in zip(got[k], cut, cut[1:])]) for k, cut in ((1, filled(chunk.vocabulary)), (2, filled(chunk.pairs))))
            c2, c1, c12 = words[chunk.index], words[chunk.before], pairs[chunk.pair]
            begins = np.cumsum(chunk.lengths) - chunk.lengths
            known = np.add.reduceat((c2 > 0).astype(np.int64), begins)
            logs = np.add.reduceat(np.log10(c2 + 1.0), begins)
            on = chunk.trained
            cells, sizes = np.unique(level(c1[on]) << 32 | level(c12[on]) << 16 | level(c2[on]), return_counts=True)
            kinds = column(row, "ids").type
            values = [column(row, "ids"), column(row, "train"), column(row, "lengths"), pa.array([known], pa.list_(pa.int64())), pa.array([logs], pa.list_(pa.float64())), pa.array([squeezed(c2.astype(np.uint64))], pa.binary()), pa.array([squeezed(c12.astype(np.uint64))], pa.binary()), pa.array([cells], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))]
            assert values[0].type == kinds
            got[1].clear(), got[2].clear()
            return pa.RecordBatch.from_arrays(values, names=names)

        def filled(hashes: np.ndarray) -> np.ndarray:
            """Where the answers of owners that were asked begin, and the end."""
            return np.unique(_ranges(hashes, owners))

        for batch in batches:
            parts = column(batch, "part").to_pylist()
            for i, part in enumerate(parts):
                if part in (0, 3) and chunk is not None:
                    yield resolved()
                    chunk = None
                if part == 0:
                    chunk, row = _opened(batch, i), batch.slice(i, 1).select(["ids", "train", "lengths"])
                elif part == 3:
                    totals = restored(column(batch, "counts")[i].as_py(), np.uint64).astype(np.int64)
                    empty = [pa.nulls(1, t) for t in (column(batch, "ids").type, pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*empty, pa.array([totals], pa.list_(pa.int64()))], names=names)
                else:
                    got[part].append(column(batch, "counts")[i].as_py())
        if chunk is not None:
            yield resolved()

    met = both.repartition(tasks, "chunk").sortWithinPartitions("chunk", "part", "owner")
    schema = f"ids array<{kind}>, train array<boolean>, lengths array<bigint>, known array<bigint>, logs array<double>, words binary, pairs binary, cells array<bigint>, sizes array<bigint>, totals array<bigint>"
    return met.mapInArrow(apply, schema)


def _cells(resolved: DataFrame) -> list:
    """The histogram's cells and their sizes over all chunks; there are at most some ten thousand cells."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            parts = [column(batch, c).drop_null().flatten().to_numpy() for c in ("cells", "sizes")]
            cells, inverse = np.unique(np.concatenate([cells, parts[0]]), return_inverse=True)
            sizes = np.bincount(inverse, np.concatenate([sizes, parts[1]]), len(cells)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sizes)], names=["cell", "size"])

    return resolved.select("cells", "sizes").mapInArrow(apply, "cell long, size long").groupBy("cell").agg(F.sum("size").alias("size")).collect()


def bucket(context: np.ndarray, settings: Interpolation) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 1) + 1e-9).astype(np.int64) + (np.asarray(context) > 0), settings.buckets - 1)


def mixture_weights(cells: np.ndarray, sizes: np.ndarray, tokens: int, distinct: int, settings: Interpolation) -> np.ndarray:
    """Weights of pair, token and unseen part by context bucket, by expectation-maximisation on deleted counts."""
    c1, c12, c2 = (middle(x) for x in (cells >> 32, cells >> 16 & 0xFFFF, cells & 0xFFFF))
    # The deleted occurrence is one of the context, of the pair and of the token.
    parts = np.stack([np.where(c1 > 1, np.maximum(c12 - 1, 0) / np.maximum(c1 - 1, 1), 0), np.maximum(c2 - 1, 0) / max(1, tokens - 1), np.full(len(cells), 1 / (distinct + 1))], 1)
    of = bucket(c1, settings)
    weights = np.full((settings.buckets, 3), 1 / 3)
    for _ in range(settings.rounds):
        share = parts * weights[of]
        share *= (sizes / np.maximum(share.sum(1), 1e-300))[:, None]
        # One imagined occurrence for each part keeps every weight above nothing.
        sums = np.stack([np.bincount(of, share[:, k], settings.buckets) for k in range(3)], 1) + 1 / 3
        weights = sums / sums.sum(1, keepdims=True)
    unseen = np.array([0.0, *weights[0, 1:]])
    weights[0] = unseen / unseen.sum() if tokens else (0, 0, 1)  # bucket 0: contexts never seen
    return weights


def scores(docs: DataFrame, settings: Interpolation = Interpolation()) -> DataFrame:
    """One row per row of docs (doc_id, text, train): doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", "train")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // settings.owner_bytes)
    chunked = written(chunks(docs, settings))
    if owners <= settings.fan:
        resolved = counted(chunked, answers(requests(chunked, owners), owners), owners, owners, kind)
    else:
        wide = int(np.ceil(np.sqrt(owners)))
        resolved = counted(chunked, grouped_answers(requests(chunked, wide), wide, -(-chunked.count() // wide)), wide, owners, kind)
    resolved = written(resolved)
    tokens, distinct = (int(x or 0) for x in resolved.where("totals is not null").agg(F.sum(F.col("totals")[0]), F.sum(F.col("totals")[1])).first())
    histogram = _cells(resolved)
    weights = mixture_weights(np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], float), tokens, distinct, settings)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = column(batch, "ids").slice(i, 1).flatten()
                lengths, known, logs = (column(batch, c).slice(i, 1).flatten().to_numpy() for c in ("lengths", "known", "logs"))
                c2, c12 = (restored(column(batch, c)[i].as_py(), np.uint64).astype(np.float64) for c in ("words", "pairs"))
                begins = np.cumsum(lengths) - lengths
                c1 = np.concatenate([c2[-1:], c2[:-1]])  # a chunk ends, as every text does, with an end token
                w = weights[bucket(c1, settings)]
                p = w[:, 0] * c12 / np.maximum(c1, 1) + w[:, 1] * c2 / max(1, tokens) + w[:, 2] / (distinct + 1)
                score = np.add.reduceat(np.log10(p), begins)
                base = logs - lengths * np.log10(tokens + distinct + 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), tokens)), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = resolved.where("totals is null").select("ids", "lengths", "known", "logs", "words", "pairs")
    return rows.mapInArrow(apply, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scored(docs: DataFrame, settings: Interpolation = Interpolation()) -> DataFrame:
    """scores, and held_out: learns from the rows whose crc32 of the id modulo 7 is not 2."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    rows = scores(docs.select("doc_id", "text", F.coalesce(remainder != 2, F.lit(False)).alias("train")), settings)
    return rows.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
