"""Vectorised text handling on Arrow batches.

Everything here works on the UTF-8 bytes of an Arrow string column.  The six
white-space characters the operators know (0x20, 0x09-0x0D) and the letters
A-Z are single bytes that never occur inside a longer UTF-8 sequence, so
words can be found, lower-cased and hashed without decoding a text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are handled at once; bounds the working memory of a task.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Ranges of more bytes than this are hashed one by one.
_SHORT = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of 64-bit hashes."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + mix(b + np.uint64(0x632BE59BD9B4E019)))


class Texts:
    """The bytes of a string column; null counts as empty."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type)
        self.n = len(column)
        kind = np.int64 if wide else np.int32
        buffers = column.buffers()
        if self.n == 0 or buffers[1] is None:
            self.offsets, self.data = np.zeros(self.n + 1, np.int64), np.empty(0, np.uint8)
            return
        at = np.frombuffer(buffers[1], kind)[column.offset : column.offset + self.n + 1].astype(np.int64)
        raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
        self.data, self.offsets = raw[at[0] : at[-1]], at - at[0]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about limit bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = Texts(batch.column(batch.schema.get_field_index(column))).offsets
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
        del batch
        pa.default_memory_pool().release_unused()


class Words:
    """The words of some texts: byte ranges, and for each text its range of words."""

    def __init__(self, texts: Texts):
        data, at, n = texts.data, texts.offsets, len(texts.data)
        inside = ~SPACE[data]
        edges = at[(at > 0) & (at < n)]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edges], after[edges - 1] = False, False
        self.data = data
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.of = np.searchsorted(self.starts, at)  # words of text i: of[i]:of[i + 1]
        self.counts = np.diff(self.of)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(LOWER[self.data] if lower else self.data, self.starts, self.ends)


class _Lanes:
    """Bytes as little-endian 64-bit values that may begin at any of them."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = data
        self.whole = padded[: len(padded) // 8 * 8].view(np.uint64)

    def __call__(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Up to eight bytes from each place on, of which lengths tells how many count."""
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        low = self.whole[word] >> shift
        high = (self.whole[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return (low | high) & _MASKS[np.minimum(lengths, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time are mixed into them."""
    lengths = ends - starts
    out = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D)
    lanes, some = _Lanes(data), np.flatnonzero(lengths <= _SHORT)
    for k in range(0, _SHORT, 8):
        some = some[lengths[some] > k]
        if not len(some):
            break
        out[some] = mix(out[some] ^ lanes(starts[some] + k, lengths[some] - k)) * np.uint64(0x9FB21C651E98DF25)
    for i in np.flatnonzero(lengths > _SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].data, 20240229)
    return mix(out)


def same_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray, at: np.ndarray, other_lengths: np.ndarray) -> np.ndarray:
    """Whether each range of data has the bytes of the range of other beside it."""
    same, left, right = lengths == other_lengths, _Lanes(data), _Lanes(other)
    some = np.flatnonzero(same & (lengths <= _SHORT))
    for k in range(0, _SHORT, 8):
        some = some[lengths[some] > k]
        if not len(some):
            break
        same[some] &= left(starts[some] + k, lengths[some] - k) == right(at[some] + k, lengths[some] - k)
    for i in np.flatnonzero(same & (lengths > _SHORT)).tolist():
        same[i] = np.array_equal(data[starts[i] : starts[i] + lengths[i]], other[at[i] : at[i] + lengths[i]])
    return same


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, ..., start + length - 1 of each range, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class _Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.room, self.n = np.empty(1024, kind), 0

    def __len__(self) -> int:
        return self.n

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.empty(max(len(self.room) * 3 // 2, self.n + len(values)), self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


class WordMemo:
    """Token ids by word, so that each distinct word is tokenised once in a worker.

    Tokenisers that never merge over white space give a text the ids of its
    words, one after the other.  Words are found by their 64-bit hash and
    compared byte by byte; one that shares its hash with another has a place
    of its own.  Beyond limit words or limit_bytes of them the memo starts
    afresh, so its size is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 1_200_000, limit_bytes: int = 64 << 20):
        self.encode, self.limit, self.limit_bytes = encode, limit, limit_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted hashes; the slot of each
        self._start, self._length, self._ids = _Growing(np.int64), _Growing(np.int32), _Growing(np.int32)
        self._bytes, self._at, self._size = _Growing(np.uint8), _Growing(np.int64), _Growing(np.int64)
        self.twins: dict[bytes, int] = {}  # slots of words whose hash another word has

    start = property(lambda self: self._start.all)
    length = property(lambda self: self._length.all)
    ids = property(lambda self: self._ids.all)

    def _enter(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The new slots of new words."""
        first = len(self._start)
        for i in range(0, len(starts), 20_000):
            s, e = starts[i : i + 20_000], ends[i : i + 20_000]
            got = self.encode([data[a:z].tobytes().decode("utf-8", "replace") for a, z in zip(s, e)])
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            self._start.add(len(self._ids) + np.cumsum(lengths) - lengths)
            self._length.add(lengths)
            self._ids.add(np.fromiter((x for word in got for x in word), np.int32, int(lengths.sum())))
            self._at.add(len(self._bytes) + np.cumsum(e - s) - (e - s))
            self._size.add(e - s)
            self._bytes.add(data[ranges(s, e - s)])
        return np.arange(first, len(self._start))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each word; until the next call, start, length and ids hold what a slot has."""
        codes, distinct = pd.factorize(hashes)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        if len(self._start) and (not known.all() and len(self._start) + (~known).sum() > self.limit or len(self._bytes) > self.limit_bytes):
            self.clear()
            at, known = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort(distinct[new])]
            first = np.full(len(distinct), -1, np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            slots = self._enter(data, starts[first[new]], ends[first[new]])
            self.keys, self.slots = (np.insert(a, at[new], b) for a, b in ((self.keys, distinct[new]), (self.slots, slots)))
            at = np.searchsorted(self.keys, distinct)
        out = self.slots[at][codes] if len(codes) else np.empty(0, np.int64)
        same = same_spans(data, starts, ends - starts, self._bytes.all, self._at.all[out], self._size.all[out])
        for i in np.flatnonzero(~same).tolist():
            word = data[starts[i] : ends[i]].tobytes()
            if word not in self.twins:
                self.twins[word] = int(self._enter(data, starts[i : i + 1], ends[i : i + 1])[0])
            out[i] = self.twins[word]
        return out


_held: dict[tuple[str, str], Any] = {}


def held(kind: str, path: str, make: Callable[[str], Any]) -> Any:
    """What make makes of path, kept in this worker until another is asked for, or let_go is called: one vocabulary and memo at a time."""
    if (kind, path) not in _held:
        let_go()
        _held[kind, path] = make(path)
    return _held[kind, path]


def let_go() -> None:
    """Drops what held keeps; for tasks without a vocabulary, as workers live on from stage to stage."""
    if _held:
        _held.clear()
        gc.collect()  # a tokeniser and its memo refer to each other
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # else the C library keeps most of it
            trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
