"""Mixing sources to target weights, in fixed-length blocks of words.

The words of a source, document after document, are one stream, cut into
blocks of ``block`` words; the last may be short.  A source with a target of
t words gets about t / block slots of the mix.

The mix has ``shards`` output shards of equal numbers of slots.  Each shard
draws how many of its slots each source gets: a multinomial draw by what the
sources have left to give, so that all slots of a source are given out and
its words come within a block of its target.  The slots of a source are
numbered through the shards.  Slot j holds the block that the source's own
pseudorandom permutation maps j to, round after round.

Slots and blocks are joined by index from the blocks' side: a row knows its
place in the stream and so the blocks it touches, and the inverse permutation
says in which slots these are held, and in which shards.  So nothing but the
mixed text itself is ever shuffled for the join.  ``mixture`` adds up what
each row gives to all slots; ``mixed_documents`` lays out the shards.

The place in the stream is a running sum.  A source is split by a hash of id
and text into as many parts as its rows ask for (``part_rows`` each), summed
by part first, so no task orders a whole source.  Shards are drawn for
``_GROUP`` sources at a time, groups of sources having drawn before, so no
task sees all sources if these are many.

Sources in code-point order, null last, weigh 5, 2, 1, repeating.  Together
they get ``share`` times all words; none more than ``limit`` times its own,
the excess going to the others by weight.  A block is held at most ``limit``
(rounded up) times, and so is each word.  All draws depend on the seed, the
sources and the index alone.

Null and empty texts have no words and are never taken.  Repeated rows are
each part of the stream.  An empty table has an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm._arrow import Texts, Words, column, let_go, ranges, slices
from docweave.llm._arrow import mix as scrambled
from docweave.llm._spark import joined, written


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    limit: float = 2.0
    block: int = 32
    shards: int = 64
    seed: int = 7
    part_rows: int = 4_096


#: Sources whose shards are drawn in one task.
_GROUP = 4_096
#: Text of a shard that one task lays out.
TASK_BYTES = 64 << 20


class Permutation:
    """A pseudorandom permutation of 0 .. n-1: four Feistel rounds on the next even power of two, walked until inside."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64(xxhash.xxh64_intdigest(bytes([r]), key & (1 << 64) - 1)) for r in range(4)]

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        h = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) & self.mask

    def _walk(self, x: np.ndarray, keys: list[np.uint64], inverse: bool) -> np.ndarray:
        x = x.astype(np.uint64)
        todo = np.arange(len(x))
        while len(todo):
            left, right = x[todo] >> self.half, x[todo] & self.mask
            for key in keys:
                if inverse:
                    left, right = right ^ self._mixed(left, key), left
                else:
                    left, right = right, left ^ self._mixed(right, key)
            x[todo] = left << self.half | right
            todo = todo[x[todo] >= np.uint64(self.n)]
        return x.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys, False)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys[::-1], True)


def slots_of(size: int, target: float, block: int, limit: float) -> int:
    """The slots that bring a source of so many words nearest to its target, within its limit."""
    if size <= 0 or target <= 0:
        return 0
    blocks = -(-size // block)
    rounds = int(target // size)
    rest = min(blocks, int((target - rounds * size) / block + 0.5))
    return min(rounds * blocks + rest, int(np.ceil(limit)) * blocks)


def drawn(left: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Shards by sources: how many slots each shard, with so many, gets of each source, which has so many left.

    Multinomial draws by what is left; what a source has not got is drawn again among the others.
    """
    rng, left = np.random.Generator(np.random.PCG64(seed)), left.astype(np.int64)
    out = np.zeros((len(sizes), len(left)), np.int64)
    for shard, n in enumerate(sizes):
        while n > 0:
            some = left if n >= left.sum() else np.minimum(rng.multinomial(n, left / left.sum()), left)
            out[shard] += some
            left = left - some
            n -= some.sum()
    return out


def _evenly(total: int, parts: int) -> np.ndarray:
    return np.full(parts, total // parts, np.int64) + (np.arange(parts) < total % parts)


def with_draws(sources: DataFrame, mix: Mix) -> DataFrame:
    """sources (_source, _total, _index, _target, ...) with _slots, and _ends, where its slots end in each shard."""
    blocks = F.ceil(F.col("_total") / mix.block).cast("long")
    rounds = F.floor(F.col("_target") / F.col("_total")).cast("long")
    rest = F.least(blocks, ((F.col("_target") - rounds * F.col("_total")) / mix.block + 0.5).cast("long"))
    slots = F.least(rounds * blocks + rest, blocks * int(np.ceil(mix.limit)))
    table = written(sources.withColumn("_slots", F.when((F.col("_total") > 0) & (F.col("_target") > 0), slots).otherwise(F.lit(0)).cast("long")).withColumn("_group", F.floor(F.col("_index") / _GROUP).cast("long")))
    groups = sorted((r[0], r[1]) for r in table.groupBy("_group").agg(F.sum("_slots")).collect())  # a row for each _GROUP sources
    total = sum(n for _, n in groups)
    by_shard = drawn(np.array([n for _, n in groups], np.int64), _evenly(total, mix.shards), _key(mix.seed, None))
    sizes = {g: by_shard[:, k].tolist() for k, (g, _) in enumerate(groups)}
    schema = T.StructType([*table.drop("_group").schema.fields, T.StructField("_ends", T.ArrayType(T.LongType()))])

    def draw(own: pa.Table) -> pa.Table:
        own = own.sort_by("_index")
        group = own.column("_group")[0].as_py()
        ends = np.cumsum(drawn(own.column("_slots").to_numpy(), np.array(sizes[group]), _key(mix.seed, str(group))), axis=0)
        return own.drop_columns(["_group"]).append_column("_ends", pa.array(list(ends.T), pa.list_(pa.int64())))

    return written(table.groupBy("_group").applyInArrow(draw, schema))


def _key(seed: int, source: str | None) -> int:
    name = b"\x00" if source is None else b"\x01" + source.encode()
    return xxhash.xxh64_intdigest(name, seed)


def sized(docs: DataFrame, text_col: str, carried: bool) -> DataFrame:
    """docs with _size, the words of a row, and _tie, a hash of its text; the text itself goes on if carried."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in slices(batches, text_col):
            texts = Texts(column(part, text_col))
            counts = Words(texts).counts
            ties = pa.array([xxhash.xxh64_intdigest(texts.text(i)) >> 1 for i in range(texts.n)], pa.int64())
            names = [x for x in part.schema.names if carried or x != text_col]
            yield pa.RecordBatch.from_arrays([*(column(part, x) for x in names), pa.array(counts.astype(np.int64)), ties], names=[*names, "_size", "_tie"])

    fields = [f for f in docs.schema if carried or f.name != text_col]
    return docs.mapInArrow(apply, T.StructType([*fields, T.StructField("_size", T.LongType()), T.StructField("_tie", T.LongType())]))


def _ordered(sources: DataFrame) -> DataFrame:
    """sources with _index, their place in code-point order, null last, found without sorting them in one task."""
    spread = written(sources.orderBy(F.col("_source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in spread.groupBy(part.alias("p")).count().collect())  # a row for each task of the sort
    before, n = {}, 0
    for p, count in counts:
        before[p], n = n, n + count
    if len(before) <= 1:
        return spread.withColumn("_index", place)
    offset = F.create_map(*(F.lit(x) for p, n in before.items() for x in (p, n)))
    return spread.withColumn("_index", offset[part] + place)


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """sources (_source, _total, _rows) with _index and _target: words by weight, none above its limit."""
    weight = F.array(*(F.lit(float(w)) for w in mix.weights))[(F.col("_index") % len(mix.weights)).cast("int")]
    table = written(_ordered(sources).select("_source", "_total", "_rows", "_index", weight.alias("_weight"), (F.col("_total") * mix.limit).alias("_most")))
    budget = float(table.agg(F.sum("_total")).first()[0] or 0) * mix.share
    level, capped = 0.0, -1
    while True:  # a source once at its limit stays there, so this ends
        full = F.col("_weight") * level > F.col("_most") if capped >= 0 else F.lit(False)
        row = table.agg(F.sum(F.when(full, F.col("_most"))), F.sum(F.when(~full, F.col("_weight"))), F.count(F.when(full, 1))).first()
        if row[2] == capped or not row[1]:
            break
        level, capped = (budget - (row[0] or 0.0)) / row[1], row[2]
    return table.withColumn("_target", F.least(F.col("_most"), F.col("_weight") * level)).drop("_weight", "_most")


def _beside(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of the source that each is from."""
    if sources.limit(_GROUP + 1).count() <= _GROUP:
        return rows.join(F.broadcast(sources), rows["_from"].eqNullSafe(sources["_source"]))
    return joined(rows, sources, {"_from": "_source"}, "_rows", "_id")


def placed(docs: DataFrame, source_col: str, text_col: str, id_col: str, mix: Mix, carried: bool) -> DataFrame:
    """docs with _size, _offset (words of its source before it), and _source, _total, _target, _index, _slots and _ends of its source."""
    bare = docs.select(docs[id_col], docs[source_col], docs[text_col])
    counted = written(sized(bare, text_col, False).select(F.col(id_col).alias("_id"), F.col(source_col).alias("_from"), "_size", "_tie"))
    sources = with_draws(targets(counted.groupBy(F.col("_from").alias("_source")).agg(F.sum("_size").alias("_total"), F.count("*").alias("_rows")), mix), mix)
    if carried:
        rows = sized(docs, text_col, True).withColumns({"_id": F.col(id_col), "_from": F.col(source_col)})
    else:
        rows = counted
    part = F.pmod(F.xxhash64("_id", "_tie"), F.ceil(F.col("_rows") / mix.part_rows).cast("long"))
    known = sources.select("_source", "_index", "_rows")
    rows = _beside(rows, known).withColumn("_part", part).drop("_source", "_rows")
    parts = _beside(counted, known).groupBy("_index", part.alias("_part")).agg(F.sum("_size").alias("_words"))
    before = Window.partitionBy("_index").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("_index").alias("_i"), F.col("_part").alias("_p"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_index", "_part").orderBy("_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    rows = rows.join(parts, (rows["_index"] == parts["_i"]) & (rows["_part"] == parts["_p"]))
    rows = rows.withColumn("_offset", F.col("_base") + F.col("_within")).drop("_index")
    return _beside(rows, sources)


class _Source:
    """The slots of one source: which blocks they hold and in which shards they lie."""

    def __init__(self, name: str | None, size: int, slots: int, ends: np.ndarray, mix: Mix):
        self.key = _key(mix.seed, name)
        self.blocks, self.slots, self.ends = max(1, -(-size // mix.block)), slots, ends
        self.order = Permutation(self.blocks, self.key)

    def holding(self, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By round: which of the blocks are held, by which slots, in which shards."""
        slot = self.order.inverse(blocks)
        which = np.flatnonzero(slot < self.slots)
        while len(which):
            yield which, slot[which], np.searchsorted(self.ends, slot[which], "right")
            slot = slot + self.blocks
            which = np.flatnonzero(slot < self.slots)


def _touched(part: pa.RecordBatch, mix: Mix, sources: dict) -> Iterator[tuple[_Source, np.ndarray, np.ndarray, np.ndarray]]:
    """By source: for each block that rows of it touch the row, the block and the words of the row in it."""
    names, size, offset = column(part, "_source").to_pylist(), column(part, "_size").to_numpy(), column(part, "_offset").to_numpy()
    total, slots, index, ends = column(part, "_total").to_numpy(), column(part, "_slots").to_numpy(), column(part, "_index").to_numpy(), column(part, "_ends")
    for i in np.unique(index):
        rows = np.flatnonzero(index == i)
        if i not in sources:
            if len(sources) > 10_000:
                sources.clear()
            sources[i] = _Source(names[rows[0]], int(total[rows[0]]), int(slots[rows[0]]), np.array(ends[rows[0]].as_py()), mix)
        some = rows[size[rows] > 0]
        low, high = offset[some] // mix.block, (offset[some] + size[some] - 1) // mix.block
        of = np.repeat(some, high - low + 1)
        block = ranges(low, high - low + 1)
        words = np.minimum((block + 1) * mix.block, (offset + size)[of]) - np.maximum(block * mix.block, offset[of])
        yield sources[i], of, block, words


def mixture(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, and in how many shards words of it lie."""
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[source_col].cast("string").alias("source"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources: dict = {}
        for part in batches:
            taken, spread = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for source, of, block, words in _touched(part, mix, sources):
                seen = []
                for which, _, shard in source.holding(block):
                    taken += np.bincount(of[which], words[which], part.num_rows).astype(np.int64)
                    seen.append(np.unique(of[which] * mix.shards + shard))
                if seen:
                    spread += np.bincount(np.unique(np.concatenate(seen)) // mix.shards, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([column(part, "_id"), *(column(part, x) for x in ("_size", "_total", "_target")), pa.array(taken), pa.array(spread)], names=["doc_id", "size", "source_size", "target", "taken", "n_shards"])

    rows = placed(chosen, "source", "text", "doc_id", mix, False).select("_id", *_PLACE)
    return rows.mapInArrow(apply, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, size long, source_size long, target double, taken long, n_shards long")


_PLACE = ["_source", "_index", "_size", "_total", "_target", "_slots", "_ends", "_offset"]


def blocks_taken(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each slot and each row of docs that its block has words of: doc_id, source, shard, slot, block, first (of the row's words), n_words."""
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[source_col].cast("string").alias("source"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources: dict = {}
        for part in batches:
            offset = column(part, "_offset").to_numpy()
            for source, of, block, words in _touched(part, mix, sources):
                for which, slot, shard in source.holding(block):
                    o, b = of[which], block[which]
                    values = [column(part, "_id").take(pa.array(o)), column(part, "_source").take(pa.array(o)), *(pa.array(x) for x in (shard, slot, b, np.maximum(b * mix.block - offset[o], 0), words[which]))]
                    yield pa.RecordBatch.from_arrays(values, names=["doc_id", "source", "shard", "slot", "block", "first", "n_words"])

    rows = placed(chosen, "source", "text", "doc_id", mix, False).select("_id", *_PLACE)
    return rows.mapInArrow(apply, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, source string, shard long, slot long, block long, first long, n_words long")


def mixed_documents(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The mix as rows with the columns of docs.

    A row is what a slot holds of one document: the run of its words that lie
    in the slot's block.  The text of a run is cut from the original, white
    space within it kept (a whole document is its whole text); length_col,
    where docs has it, is set to its characters.  Rows of one shard lie
    together, in a pseudorandom order that mixes the sources; a shard is as
    many tasks and files as its size asks for.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {x: f"c{i}" for i, x in enumerate(docs.columns)}
    text, source, own = at[text_col], at[source_col], at[id_col]
    length, names = at.get(length_col), plain.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources: dict = {}
        for part in slices(batches, text):
            texts = Texts(column(part, text))
            words = Words(texts)
            row_of, first_of, last_of, shards, places = [], [], [], [], []
            for found, of, block, n in _touched(part, mix, sources):
                begin = np.maximum(block * mix.block - column(part, "_offset").to_numpy()[of], 0)
                for which, slot, shard in found.holding(block):
                    row_of.append(of[which])
                    first_of.append(begin[which])
                    last_of.append((begin + n)[which])
                    shards.append(shard)
                    places.append(scrambled(slot.astype(np.uint64) ^ np.uint64(found.key)) >> np.uint64(1))
            if not row_of:
                continue
            o, b, e = (np.concatenate(x) for x in (row_of, first_of, last_of))
            whole = (b == 0) & (e == words.counts[o])
            low = np.where(whole, texts.offsets[o], words.starts[words.of[o] + b]) if len(o) else o
            high = np.where(whole, texts.offsets[o + 1], words.ends[words.of[o] + e - 1]) if len(o) else o
            rows = part.take(pa.array(o))
            cut = pa.array([texts.data[x:y].tobytes() for x, y in zip(low, high)], pa.binary()).cast(pa.string())
            arrays = {x: column(rows, x) for x in names}
            arrays[text] = cut.cast(arrays[text].type)
            if length:
                arrays[length] = pc.utf8_length(cut).cast(arrays[length].type)
            arrays["_shard"], arrays["_place"] = pa.array(np.concatenate(shards)), pa.array(np.concatenate(places).astype(np.int64))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    place = placed(plain, source, text, own, mix, True).select(*plain.columns, *_PLACE)
    rows = place.mapInArrow(apply, T.StructType([*plain.schema.fields, T.StructField("_shard", T.LongType()), T.StructField("_place", T.LongType())]))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(docs[text_col])), F.lit(0))).first()[0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size * mix.share) // TASK_BYTES)
    laid = rows.withColumn("_cut", F.pmod("_place", F.lit(-(-tasks // mix.shards)))).repartition(tasks, "_shard", "_cut")
    return laid.sortWithinPartitions("_shard", "_place").select(*(F.col(c).alias(x) for c, x in zip(plain.columns, docs.columns)))
