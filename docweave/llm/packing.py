"""Packing token sequences by bounded-space online best-fit.

Each task reads its documents once and keeps at most ``windows`` open
windows.  A document's ids go, 2,048 at a time, into sequences of their own;
the rest goes into the open window that it leaves least room in.  If it fits
nowhere and no window can be opened, the fullest window is filled up with the
beginning of the rest and emitted, so that no window of a task is emitted
with padding.  What a task has open at its end is merged: the leftovers of
``merged`` tasks are laid end to end and cut at every 2,048 ids, and the last,
short stretch into sequences whose lengths are powers of two, which need no
padding.

A document's ids are those that the tokeniser file gives to its text, added
tokens that occur in it included, then one end id; a null text is
empty.  Ids are carried only for leftovers; every other piece leaves its task
as a row of numbers.  A task's memory is its windows and one slice of texts.
Repeated rows are packed each, under their id.  An empty table has no
sequences.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._arrow import LOWER, SPACE, Texts, WordMemo, Words, column, held, ranges, slices, span_hashes
from docweave.llm._spark import written


@dataclass(frozen=True)
class Packing:
    vocabulary: str
    capacity: int = 2048
    windows: int = 32
    merged: int = 64
    end_id: int = 1


PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True
#: Rules of a tokeniser file under which a text's ids are those of the stretches that pretokens() cuts, A-Z lower-cased.
_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def pretokens(texts: Texts, added: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges that the tokeniser never merges over, and for each text its range of them.

    Besides at white space it cuts between an ASCII letter and an ASCII mark
    (the apostrophe aside), so that a word is one with and without a comma,
    and around what matches added, which is never cut itself.
    """
    words, data = Words(texts), texts.data
    letter, mark = _LETTER[data], _MARK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = letter[1:] & mark[:-1] | mark[1:] & letter[:-1]
    begins, stops = cut.copy(), cut
    if added is not None and added.search(data.tobytes()):
        for i in range(texts.n):
            for m in added.finditer(texts.text(i)):
                a, z = m.start() + texts.offsets[i], m.end() + texts.offsets[i]
                for edges in (begins, stops):
                    edges[a + 1 : z] = False
                    edges[[a, z]] = True
        space = np.append(SPACE[data], True)
        begins &= ~space
        begins[texts.offsets[1:][np.diff(texts.offsets) > 0]] = False  # words.starts says whether one begins there
        before = np.append(True, space[:-1])
        before[texts.offsets] = True
        stops &= ~before
    begins[words.starts], stops[words.ends] = True, True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops), np.searchsorted(starts, texts.offsets)


class Tokenizer:
    """The ids that a tokeniser file gives to texts.

    Files with the rules above are asked for distinct stretches only, each
    once in a worker; with others every text is tokenised as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Model

        self.model = Model.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        added = rules["added_tokens"]
        split = (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        plain = all(not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"]) and " " not in x["content"] for x in added)
        known = (rules["normalizer"] or {}).get("normalizers") == list(_NORMALIZERS) and split[0].get("pattern") == {"Regex": _SPLIT}
        self.memo = WordMemo(self._encoded) if plain and known and not rules["post_processor"] else None
        # Of those that begin at one place the longest is found.
        self.added = re.compile(b"|".join(re.escape(x["content"].encode()) for x in sorted(added, key=lambda x: -len(x["content"])))) if added else None

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and end."""
        if self.memo is None:
            found = self._encoded([texts.text(i).decode() for i in range(texts.n)])
            return np.array([x for ids in found for x in ids], np.int32), np.cumsum([0, *map(len, found)])
        starts, ends, of = pretokens(texts, self.added)
        lower = LOWER[texts.data]
        slots = self.memo(lower, starts, ends, span_hashes(lower, starts, ends))
        lengths = self.memo.length[slots]
        return self.memo.ids[ranges(self.memo.start[slots], lengths)], np.concatenate([[0], np.cumsum(lengths)])[of]


def tokenizer(path: str) -> Tokenizer:
    return held("tokenizer", path, Tokenizer)


class _Windows:
    """Open windows of one task, and the pieces of the sequences it has emitted."""

    def __init__(self, packing: Packing, first: int):
        self.packing, self.next = packing, first
        self.open: list[list] = []  # room, pieces
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        room, at, total = self.packing.capacity, 0, len(ids)
        while total - at >= room:
            self.emit([(doc, at, ids[at : at + room], total)])
            at += room
        while at < total:
            rest = total - at
            fits = [w for w in self.open if w[0] >= rest]
            if fits:
                window = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.packing.windows:
                self.open.append(window := [room, []])
            else:
                window = min(self.open, key=lambda w: w[0])
            n = min(rest, window[0])
            window[1].append((doc, at, ids[at : at + n].copy(), total))
            window[0] -= n
            at += n
            if not window[0]:
                self.emit(window[1])
                self.open = [w for w in self.open if w is not window]


def pack(docs: DataFrame, packing: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{x} long' for x in PIECE)}"

    def rows(found: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*found)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(columns[0], doc_type), *(pa.array(x, pa.int64()) for x in columns[1:])], names=["doc_id", *PIECE])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        windows, tokens, doc_type = _Windows(packing, task << 36), tokenizer(packing.vocabulary), None

        def with_ids(batch: pa.RecordBatch, ids: list[bytes | None]) -> pa.RecordBatch:
            n = batch.num_rows
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(np.full(n, task, np.int64))], names=[*batch.schema.names, "_ids", "_task"])

        for part in slices(batches, "text"):
            own = column(part, "doc_id")
            doc_type = own.type
            ids, of = tokens(Texts(column(part, "text")))
            ids = ids.astype("<u4")
            for i, doc in enumerate(own.to_pylist()):
                windows.add(doc, np.append(ids[of[i] : of[i + 1]], np.uint32(packing.end_id)))
            yield with_ids(rows(windows.out, doc_type), [None] * len(windows.out))
            windows.out = []
        left = [p for w in windows.open for p in w[1]]
        if left:
            yield with_ids(rows([(doc, start, len(x), 0, total, 0, 0) for doc, start, x, total in left], doc_type), [x.tobytes() for _, _, x, _ in left])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled, windows, group = [], 0, None, None

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal held, filled
            while held:  # the rest, in powers of two
                n = 1 << (filled.bit_length() - 1)
                windows.emit(taken(n))
            if windows and windows.out:
                yield rows(windows.out, doc_type)
                windows.out = []

        def taken(n: int) -> list[tuple]:
            nonlocal held, filled
            pieces, filled = [], filled - n
            while n:
                doc, start, x, total = held[0]
                m = min(n, len(x))
                pieces.append((doc, start, x[:m], total))
                n -= m
                held[0] = (doc, start + m, x[m:], total)
                if m == len(x):
                    held.pop(0)
            return pieces

        for batch in batches:
            doc_type = column(batch, "doc_id").type
            for g, doc, start, total, x in zip(*(column(batch, c).to_pylist() for c in ("_group", "doc_id", "start", "doc_tokens", "_ids"))):
                if g != group:
                    yield from closed()
                    windows, group = _Windows(packing, (1 << 62) + (g << 36)), g
                held.append((doc, start, np.frombuffer(x, "<u4"), total))
                filled += len(held[-1][2])
                while filled >= packing.capacity:
                    windows.emit(taken(packing.capacity))
        yield from closed()

    packed = written(chosen.mapInArrow(fill, f"{schema}, _ids binary, _task long"))
    done = packed.where("_ids is null").select("doc_id", *PIECE)
    left = packed.where("_ids is not null").withColumn("_group", F.floor(F.col("_task") / packing.merged).cast("long"))
    left = left.repartition("_group").sortWithinPartitions("_group", "_task")
    return done.union(left.select("_group", "doc_id", "start", "doc_tokens", "_ids").mapInArrow(merge, schema))
