"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

A fingerprint's bit is set if it is set in over half of the hashes of the
text's word shingles.  Texts of one fingerprint are one class; the index
holds each class once, with its number of texts.

Two fingerprints that differ in at most two bits agree on at least two of
four 16-bit quarters.  For each of the six pairs of quarters the fingerprint
is rearranged with that pair in front, and classes that agree there meet in
one task.  Should more than ``HOT`` classes share a front, they are split once
more: of three parts of the other 32 bits at least one is equal too, so each
class goes to three smaller groups.  The task sorts them by the rank of the rearranged bits in the
reflected Gray code, so that neighbours share long bit patterns, and factors
those out: the upper node of a group is the shared front, below it are nodes
for 8, 16 and 24 further bits, and the leaves.  A search walks pairs of nodes
downwards, adds up the bits in which their own patterns differ, and drops a
pair of nodes with everything below as soon as the sum exceeds the limit.  A
link is reported by the first arrangement in which its ends meet.

Each text gets its class's result by a join on the fingerprint; classes of
very many texts are broadcast there and their texts spread over all tasks.

Texts without a word have fingerprint zero and link like any other; null
texts are empty.  Repeated rows count as texts of their class.  A null id is
never a component's id unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._arrow import Texts, column, let_go, ranges, slices
from docweave.llm._spark import joined, small, written
from docweave.llm.components import components

RADIUS = 2
SEED = 42
WORDS = 3
ARRANGEMENTS = [[*front, *(q for q in range(4) if q not in front)] for front in combinations(range(4), 2)]
HOT = 1 << 20
_PARTS = ((0, 11), (11, 11), (22, 10))  # shift and width of the three parts of the bits behind a front
_STEPS = (32, 24, 16, 8, 0)  # bits below the nodes of each level
_BLOCK = 1 << 20  # pairs of nodes that are expanded at once


def fingerprint(text: bytes) -> int:
    """The SimHash of one text, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
        starts = [0, *(g + 1 for g in gaps[: len(gaps) - WORDS + 2])]
        ends = [*gaps[WORDS - 1 :], len(joined)]
        hashes = np.array([digest(joined[a:z], SEED) for a, z in zip(starts, ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tie, fp for docs of doc_id, tie and text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in slices(batches, "text"):
            texts = Texts(column(part, "text"))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "tie"), pa.array([fingerprint(texts.text(i)) for i in range(texts.n)], pa.int64())], names=["doc_id", "tie", "fp"])

    return docs.mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie long, fp long")


def _quarter(x: np.ndarray, q: int) -> np.ndarray:
    return (x >> np.uint64(48 - 16 * q)) & np.uint64(0xFFFF)


def _arranged(x: np.ndarray, order: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for q in order:
        out = out << np.uint64(16) | _quarter(x, q)
    return out


def _restored(x: np.ndarray, order: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for k, q in enumerate(order):
        out |= _quarter(x, k) << np.uint64(48 - 16 * q)
    return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of a code word in the reflected Gray code."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def search(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of codes that agree in the 32 front bits and differ in at most RADIUS others; codes are distinct, those of one front lie together, in Gray order."""
    n = len(codes)
    if n < 2:
        return
    begins = []  # of each level: where its nodes begin among the codes
    for below in _STEPS:
        pattern = codes >> np.uint64(below)
        begins.append(np.append(np.flatnonzero(np.concatenate([[True], pattern[1:] != pattern[:-1]])), n))
    children = [np.searchsorted(begins[k + 1], begins[k]) for k in range(len(_STEPS) - 1)]
    top = np.flatnonzero(np.diff(begins[0]) > 1)
    stack = [(0, top, top, np.zeros(len(top), np.int8))]
    while stack:
        level, a, b, differ = stack.pop()
        if level == len(_STEPS) - 1:
            if len(a):
                yield a, b
            continue
        low, high = children[level][:-1], children[level][1:]
        na, nb = (high - low)[a], (high - low)[b]
        total = np.cumsum(na * nb)
        if len(a) > 1 and total[-1] > _BLOCK:
            cut = min(max(1, int(np.searchsorted(total, _BLOCK))), len(a) - 1)
            stack += [(level, a[cut:], b[cut:], differ[cut:]), (level, a[:cut], b[:cut], differ[:cut])]
            continue
        if not len(a):
            continue
        if len(a) == 1 and total[-1] > _BLOCK:  # one wide pair of nodes: its children by rows
            rows = np.arange(low[a[0]], high[a[0]])
            step = max(1, _BLOCK // int(nb[0]))
            pieces = [(rows[i : i + step], low[b[0]], int(nb[0])) for i in range(0, len(rows), step)]
            blocks = [(np.repeat(r, w), np.tile(np.arange(s, s + w), len(r)), np.repeat(differ, len(r) * w)) for r, s, w in pieces]
        else:
            left = np.repeat(ranges(low[a], na), np.repeat(nb, na))
            right = ranges(np.repeat(low[b], na), np.repeat(nb, na))
            blocks = [(left, right, np.repeat(differ, na * nb))]
        first, shift = begins[level + 1], np.uint64(_STEPS[level + 1])
        mask = np.uint64((1 << (_STEPS[level] - _STEPS[level + 1])) - 1)
        for left, right, before in blocks:
            ordered = left <= right if level + 1 < len(_STEPS) - 1 else left < right
            left, right, before = left[ordered], right[ordered], before[ordered]
            apart = before + np.bitwise_count(((codes[first[left]] ^ codes[first[right]]) >> shift) & mask).astype(np.int8)
            near = apart <= RADIUS
            stack.append((level + 1, left[near], right[near], apart[near]))


def links(classes: DataFrame) -> DataFrame:
    """a, b, na, nb: every two classes (fp, n) that differ in at most RADIUS bits, once, with their numbers of texts."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n = column(batch, "fp").to_numpy().view(np.uint64), column(batch, "n")
            for k, order in enumerate(ARRANGEMENTS):
                rank = gray_rank(_arranged(fp, order))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array((rank >> np.uint64(32)).astype(np.int64)), pa.array(rank.view(np.int64)), n], names=["arrangement", "front", "rank", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k, order in enumerate(ARRANGEMENTS):
                for part in range(-1, len(_PARTS)):
                    own = rows[:, (rows[0] == k) & (rows[4] == part)]
                    codes, n = gray_code(own[2].view(np.uint64)), own[3]
                    fp = _restored(codes, order)
                    # Groups of one front but different parts must not look like one front.
                    bounds = np.flatnonzero(own[5, 1:] != own[5, :-1]) + 1 if part >= 0 else []
                    for at, codes_of in zip([0, *bounds], np.split(codes, bounds)):
                        for i, j in search(codes_of):
                            apart, behind = fp[at + i] ^ fp[at + j], codes_of[i] ^ codes_of[j]
                            new = np.ones(len(i), bool)
                            for earlier in ARRANGEMENTS[:k]:
                                new &= (_quarter(apart, earlier[0]) | _quarter(apart, earlier[1])) != 0
                            for shift, width in _PARTS[: max(part, 0)]:
                                new &= (behind >> np.uint64(shift)) & np.uint64((1 << width) - 1) != 0
                            i, j = at + i[new], at + j[new]
                            if len(i):
                                a, b = fp[i].view(np.int64), fp[j].view(np.int64)
                                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, n[i], n[j])], names=["a", "b", "na", "nb"])

        for batch in batches:
            rows = np.stack([column(batch, c).to_numpy().astype(np.int64) for c in ("arrangement", "front", "rank", "n", "part", "value")])
            if not rows.shape[1]:
                continue
            held.append(rows)
            last = np.flatnonzero((rows[[0, 1, 4, 5]] != rows[[0, 1, 4, 5], -1][:, None]).any(0))
            if len(last):  # all groups but the last are complete
                cut = last[-1] + 1
                yield from found(np.concatenate([*held[:-1], rows[:, :cut]], axis=1))
                held = [rows[:, cut:]]
        if held:
            yield from found(np.concatenate(held, axis=1))

    spreaded = classes.select("fp", "n").mapInArrow(spread, "arrangement int, front long, rank long, n long")
    if classes.count() > HOT:  # else no front can be shared by more
        hot = written(spreaded.groupBy("arrangement", "front").count().where(F.col("count") > HOT).select("arrangement", "front", F.lit(True).alias("hot")))
        code = F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", 1))
        thrice = F.array(*(F.struct(F.lit(k).alias("part"), F.shiftrightunsigned(code, shift).bitwiseAND((1 << width) - 1).alias("value")) for k, (shift, width) in enumerate(_PARTS)))
        once = F.array(F.struct(F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("value")))
        marked = spreaded.join(small(hot), ["arrangement", "front"], "left").withColumn("p", F.explode(F.when(F.col("hot"), thrice).otherwise(once)))
        grouped = marked.select("arrangement", "front", "rank", "n", "p.part", "p.value")
    else:
        grouped = spreaded.withColumns({"part": F.lit(-1), "value": F.lit(-1).cast("long")})
    keys = ("arrangement", "front", "part", "value")
    return grouped.repartition(*keys).sortWithinPartitions(*keys, "rank").mapInArrow(meet, "a long, b long, na long, nb long")


def _classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, tie (a hash of the text), fp, n_near, component_id."""
    marked = written(fingerprints(docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("tie"), docs[text_col].alias("text"))))
    classes = written(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    pairs = written(links(classes))
    near = pairs.select(F.col("a").alias("fp_near"), F.col("nb").alias("n_near")).union(pairs.select("b", "na")).groupBy("fp_near").agg(F.sum("n_near").alias("others"))
    roots = components(pairs)
    member = roots.join(classes, roots.node == classes.fp).select("node", "root", "least")
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    linked = member.join(least, "root").select(F.col("node").alias("fp_linked"), "component")
    known = classes.join(near, F.col("fp") == F.col("fp_near"), "left").join(linked, F.col("fp") == F.col("fp_linked"), "left")
    known = written(known.select(F.col("fp").alias("fp_known"), "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), F.coalesce("component", "least").alias("component_id")))
    return joined(marked, known, {"fp": "fp_known"}, "n", "doc_id").select("doc_id", "tie", "fp", F.col("n_near").cast("long").alias("n_near"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, n_near, component_id."""
    return _classified(docs, id_col, text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the least of its component, with all their columns."""
    beside = ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    dropped = _classified(docs, id_col, text_col).where(beside).select(F.col("doc_id").alias("_dropped"), F.col("tie").alias("_tie")).distinct()
    return docs.join(dropped, docs[id_col].eqNullSafe(dropped["_dropped"]) & (F.xxhash64(docs[text_col]) == dropped["_tie"]), "left_anti")
