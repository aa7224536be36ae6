"""Token counts by a linear longest-match automaton.

Greedy longest-match word-piece tokenisation takes, again and again, the
longest vocabulary piece that begins where the last one ended.  A trie of the
pieces with failure links does that in one pass over a word: when a node has
no edge for the next byte, the pieces that are certain by then are popped and
matching goes on at the node that what remains leads to.  How many pieces a
node pops is precomputed along with its link, so a word's count is a sum over
the links it takes and no piece is ever built.

A word is closed by an end mark, which pieces that only end words contain.  A
word that the vocabulary cannot cut counts as one unknown token.

Distinct words are counted once per worker, many words abreast, one byte of
each at a time; words of more than ``ALONE`` bytes are walked one by one.  A
text's count is the sum over its words.  One scan, no
shuffle.  Null and empty texts have no words and no tokens; repeated rows are
each counted; other columns are not read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm._arrow import LOWER, Texts, WordMemo, Words, column, slices

END = 256
ALONE = 128
_FANOUT = 257


class Automaton:
    """A trie of pieces (sequences of bytes and END), with failure links and popped-piece counts."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                child = edges[node].get(symbol)
                if child is None:
                    child = edges[node][symbol] = len(edges)
                    edges.append({})
                    final.append(False)
                node = child
            final[node] = node != 0
        link, popped = [-1] * len(edges), [0] * len(edges)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for symbol, child in edges[node].items():
                queue.append(child)
                if final[child]:
                    link[child], popped[child] = 0, 1
                    continue
                at, n = link[node], popped[node]
                while at >= 0 and symbol not in edges[at]:
                    n += popped[at]
                    at = link[at]
                if at >= 0:
                    link[child], popped[child] = edges[at][symbol], n
        pairs = sorted((node * _FANOUT + symbol, child) for node, out in enumerate(edges) for symbol, child in out.items())
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.children = np.array([c for _, c in pairs], np.int64)
        self.link, self.popped = np.array(link, np.int64), np.array(popped, np.int64)

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The child of each state, or -1."""
        if not len(self.keys):
            return np.full(len(state), -1, np.int64)
        key = state * _FANOUT + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.children[at], -1)

    @cached_property
    def _edges(self) -> tuple[dict[int, int], list[int], list[int]]:
        return dict(zip(self.keys.tolist(), self.children.tolist())), self.link.tolist(), self.popped.tolist()

    def count(self, word: bytes) -> int:
        """Tokens of a word, -1 if the vocabulary can't cut it."""
        edges, link, popped = self._edges
        state, n = 0, 0
        for symbol in chain(word, (END,)):
            while (child := edges.get(state * _FANOUT + symbol)) is None:
                n += popped[state]
                state = link[state]
                if state < 0:
                    return -1
            state = child
        while state > 0:
            n += popped[state]
            state = link[state]
        return n if state == 0 else -1

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, -1 for those that the vocabulary can't cut."""
        out = np.empty(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= ALONE]
        out[short] = self._abreast([words[i] for i in short])
        for i in set(range(len(words))).difference(short):
            out[i] = self.count(words[i])
        return out

    def _abreast(self, words: list[bytes]) -> np.ndarray:
        order = np.argsort([-len(w) for w in words], kind="stable")
        lengths = np.array([len(words[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        state, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)

        def follow(some: np.ndarray, symbol: np.ndarray) -> None:
            while len(some):
                child = self._step(state[some], symbol)
                there = child >= 0
                state[some[there]] = child[there]
                some, symbol = some[~there], symbol[~there]
                pop(some)
                alive = state[some] >= 0
                some, symbol = some[alive], symbol[alive]

        def pop(some: np.ndarray) -> None:
            count[some] += self.popped[state[some]]
            state[some] = self.link[state[some]]

        for k in range(int(lengths.max(initial=0))):
            some = np.arange(np.searchsorted(-lengths, -k, "left"))  # words longer than k come first
            some = some[state[some] >= 0]
            follow(some, flat[begin[some] + k])
        some = np.flatnonzero(state >= 0)
        follow(some, np.full(len(some), END, np.int64))
        some = np.flatnonzero(state > 0)
        while len(some):
            pop(some)
            some = some[state[some] > 0]
        out = np.empty(len(words), np.int64)
        out[order] = np.where(state < 0, -1, count)
        return out


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def word_pieces(path: str, suffix: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file; suffix marks those that end words."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    to_byte = byte_symbols()
    pieces = []
    for piece in vocabulary:
        last = piece.endswith(suffix) and piece != suffix
        body = piece[: -len(suffix)] if last else piece
        if all(c in to_byte for c in body):
            pieces.append((*(to_byte[c] for c in body), *([END] if last else [])))
    return pieces


_memos: dict[str, WordMemo] = {}


def _memo(path: str) -> WordMemo:
    if path not in _memos:
        automaton = Automaton(word_pieces(path))
        _memos[path] = WordMemo(lambda words: [[n] for n in automaton.counts([w.encode() for w in words]).tolist()])
    return _memos[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_words, n_tokens, n_unknown; A-Z count as lower-case letters."""
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = Texts(column(part, "text"))
            words, memo = Words(texts), _memo(vocabulary)
            lower = LOWER[texts.data]
            slots = memo(lower, words.starts, words.ends, words.hashes(lower=True))
            got = memo.ids[memo.start[slots]].astype(np.int64)
            doc = words.doc()
            tokens, unknown = (np.bincount(doc, x, texts.n).astype(np.int64) for x in (np.abs(got), got < 0))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *(pa.array(x.astype(np.int64)) for x in (np.diff(texts.offsets), words.counts, tokens, unknown))], names=["doc_id", "n_bytes", "n_words", "n_tokens", "n_unknown"])

    return chosen.mapInArrow(apply, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_words long, n_tokens long, n_unknown long")
