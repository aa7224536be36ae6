"""Quality rules by tokeniser fertility.

A public vocabulary that was made for ordinary text cuts ordinary words into
few pieces.  Text that is foreign to it (symbols, encoded data, keyboard
noise, mixed scripts) needs many pieces for few characters, falls back to
bytes, or repeats a handful of pieces.  For each text three measures are
taken over its words:

* characters per token,
* byte-fallback share: tokens that stand for a single raw byte,
* token entropy in bits, of the text's own tokens.

Two bands say what is ordinary.  A wide one per script is a parameter.  A
narrow one per language is learned from the whole corpus: the quartiles of
characters per token of the texts that pass the base rules and their script's
band, widened by ``spread`` times their distance.  Few texts tell where their
quartiles lie, but hardly how far apart: with n of them, under ``least_rows``,
the distance is n / ``least_rows`` parts their own and for the rest the mean
of the script's languages, by their texts, to which the width of the script's
band is added as if it were that of one more text.  So no band is switched on or off at any number of
rows, and a language that is hardly seen is not held to where others lie.

The texts are scanned once; what is shuffled is, for each language, script and
task, the number of texts by characters per token in steps of 1 / ``STEPS``.
Quartiles are read off these counts, so they are exact to a step and the same
however the rows are partitioned.  The bands are broadcast if they are few, as
languages are; else the join on them shuffles.

Null and empty texts have no words, zero measures and fail the base rule.  A
null language counts as the empty one.  Repeated rows are each judged; other
columns are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm._arrow import SPACE, Texts, WordMemo, Words, column, held, pair, ranges, slices, span_hashes
from docweave.llm._spark import small, written

STEPS = 4096
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Band:
    """What a script's ordinary text has: least and most characters per token, most byte fallback, least entropy as a share of what so many tokens can have at most."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: Scripts by their first and last code point.  The script with most letters of a text decides its band.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew_arabic": [(0x590, 0x6FF)],
    "indic": [(0x900, 0xDFF)],
    "cjk": [(0x3040, 0x30FF), (0x3400, 0x9FFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
BANDS = {
    "latin": Band(1.45, 12.0, 0.05, 0.45),
    "greek": Band(0.7, 8.0, 0.3, 0.35),
    "cyrillic": Band(1.2, 10.0, 0.1, 0.4),
    "hebrew_arabic": Band(0.6, 8.0, 0.5, 0.35),
    "indic": Band(0.3, 8.0, 0.8, 0.3),
    "cjk": Band(0.3, 6.0, 0.75, 0.35),
    "hangul": Band(0.3, 6.0, 0.75, 0.35),
    "other": Band(0.2, 20.0, 1.0, 0.2),
}


@dataclass(frozen=True)
class Rules:
    """Where the vocabulary lies and what it is held against."""

    vocabulary: str
    bands: dict = field(default_factory=lambda: BANDS)
    least_words: int = 50
    most_repeated: int = 50  # per cent of words in repeated three-word windows
    spread: float = 3.0
    least_rows: int = 200


MEASURES = pa.schema(
    [
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("chars_per_token", pa.float64()),
        ("byte_share", pa.float64()),
        ("token_entropy", pa.float64()),
        ("script", pa.string()),
    ]
)
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string"

_names = list(SCRIPTS) + ["other"]
def _made(path: str) -> tuple[WordMemo, np.ndarray]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    raw = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return WordMemo(lambda words: model.encode(words, num_threads=1)), raw


def _memo(path: str) -> tuple[WordMemo, np.ndarray]:
    return held("pieces", path, _made)


def _sums(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of the values of[i]:of[i + 1]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[of[1:]] - total[of[:-1]]


def _script(texts: Texts) -> np.ndarray:
    """The index of the script that most letters of each text belong to."""
    data = texts.data
    lead = np.flatnonzero(data >= 0xC0)
    ascii_letters = _sums(((data | 32) >= 97) & ((data | 32) <= 122), texts.offsets)
    counts = np.zeros((len(SCRIPTS), texts.n), np.int64)
    if len(lead):
        b = np.pad(data, (0, 3))
        b0, b1, b2 = (b[lead + k].astype(np.int32) for k in range(3))
        point = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, 0x10000))
        of = np.searchsorted(lead, texts.offsets)
        for k, parts in enumerate(SCRIPTS.values()):
            counts[k] = _sums(np.logical_or.reduce([(point >= a) & (point <= z) for a, z in parts]), of)
    counts[0] += ascii_letters
    best = counts.argmax(0)
    return np.where(counts.max(0) > 0, best, len(SCRIPTS))


def _repeated_words(hashes: np.ndarray, words: Words) -> np.ndarray:
    """By text: its words in three-word windows that it has twice or more."""
    n, of, doc = len(hashes), words.of, words.doc()
    if n < 3:
        return np.zeros(len(words.counts), np.int64)
    whole = doc[:-2] == doc[2:]
    windows = np.flatnonzero(whole)
    key = pair(pair(hashes[windows], hashes[windows + 1]), hashes[windows + 2] + doc[windows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(ordered), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = windows[order[twice]]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at + k] = True
    return _sums(covered, of)


def _duplicate_lines(texts: Texts, words: Words) -> np.ndarray:
    """By text: lines with a word that equal an earlier line of it."""
    data, at = texts.data, texts.offsets
    if not len(data):
        return np.zeros(texts.n, np.int64)
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, at[:-1][np.diff(at) > 0])
    starts = starts[starts < len(data)]
    doc = np.searchsorted(at, starts, "right") - 1
    following = np.searchsorted(breaks, starts)
    ends = np.minimum(np.append(breaks, len(data))[following], at[doc + 1])
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, doc = starts[has_word], ends[has_word], doc[has_word]
    if not len(starts):
        return np.zeros(texts.n, np.int64)
    key = pair(span_hashes(data, starts, ends), doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(doc[later], minlength=texts.n).astype(np.int64)


def _entropy(ids: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """Bits, of the ids of[i]:of[i + 1] of each text."""
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    key = np.sort(doc * size + ids)
    if not len(key):
        return np.zeros(len(of) - 1)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    total = np.diff(of)
    sums = np.bincount(key[first] // size, count * np.log2(count), minlength=len(total))
    n = np.maximum(total, 1)
    return np.maximum(np.log2(n) - sums / n, 0)


def measure(batch: pa.RecordBatch, text: str, rules: Rules) -> list[pa.Array]:
    """The columns of MEASURES for the rows of a batch."""
    texts = Texts(column(batch, text))
    words = Words(texts)
    hashes = words.hashes()
    memo, raw = _memo(rules.vocabulary)
    points = (texts.data & 0xC0) != 0x80
    word_chars = _sums(points & ~SPACE[texts.data], texts.offsets)
    repeated = _repeated_words(hashes, words)
    slots = memo(texts.data, words.starts, words.ends, hashes)
    lengths = memo.length[slots]
    ids = memo.ids[ranges(memo.start[slots], lengths)]
    of = np.concatenate([[0], np.cumsum(lengths)])[words.of]
    n_tokens = np.diff(of)
    n = np.maximum(n_tokens, 1)
    chars = word_chars / n
    share = _sums(raw[ids], of) / n
    entropy = _entropy(ids, of, len(raw))
    script = _script(texts)
    band = np.array([[getattr(rules.bands[x], f) for f in ("least_chars", "most_chars", "most_bytes", "least_entropy")] for x in _names])[script].reshape(-1, 4)
    ceiling = np.log2(np.maximum(np.minimum(n_tokens, len(raw)), 2))
    failed = (words.counts < rules.least_words) | (100 * repeated > rules.most_repeated * words.counts)
    ordinary = (chars >= band[:, 0]) & (chars <= band[:, 1]) & (share <= band[:, 2]) & (entropy >= band[:, 3] * ceiling)
    values = [words.counts, word_chars, _sums(SYMBOLS[texts.data], texts.offsets), _duplicate_lines(texts, words), repeated, failed, ordinary & ~failed, n_tokens, np.where(n_tokens > 0, chars, 0.0), share, entropy, np.array(_names, object)[script]]
    return [pa.array(v, f.type) for v, f in zip(values, MEASURES)]


def _steps(measured: DataFrame) -> DataFrame:
    """_lang, _script, _step (of characters per token) and _n, how many of the texts that may be learned from are there."""
    return measured.where("_kept").groupBy("_lang", "_script", F.round(F.col("_chars_per_token") * STEPS).cast("long").alias("_step")).agg(F.count("*").alias("_n"))


def _quartiles(steps: DataFrame, *by: str) -> DataFrame:
    """Low and high quartile of characters per token (nearest rank), and number, of the texts behind steps."""
    each = steps.groupBy(*by, "_step").agg(F.sum("_n").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    ranked = each.withColumns({"_upto": F.sum("_n").over(upto), "_rows": F.sum("_n").over(Window.partitionBy(*by))})
    first = lambda share: F.min(F.when(F.col("_upto") >= F.col("_rows") * share, F.col("_step"))) / F.lit(float(STEPS))
    return ranked.groupBy(*by).agg(first(0.25).alias("_low"), first(0.75).alias("_high"), F.first("_rows").alias("_rows"))


def _script_distances(steps: DataFrame, rules: Rules) -> DataFrame:
    """By script: the mean distance of quartiles within a language, the script's band being one more text."""
    width = F.create_map(*(F.lit(x) for name in _names for x in (name, float(rules.bands[name].most_chars - rules.bands[name].least_chars))))
    sums = _quartiles(steps, "_script", "_lang").groupBy("_script").agg(F.sum((F.col("_high") - F.col("_low")) * F.col("_rows")).alias("_sum"), F.sum("_rows").alias("_n"))
    return sums.select(F.col("_script").alias("_by"), ((F.col("_sum") + width[F.col("_script")]) / (F.col("_n") + 1)).alias("_distance"))


def _judged(docs: DataFrame, rules: Rules, text_col: str, lang_col: str, dropped: tuple[str, ...] = ()) -> DataFrame:
    """docs with the columns of MEASURES, each with an underscore before its name, the verdict final."""
    names = [f"_{x}" for x in MEASURES.names]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            kept = [i for i, x in enumerate(part.schema.names) if x not in dropped]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *measure(part, text_col, rules)], names=[*(part.schema.names[i] for i in kept), *names])

    schema = T.StructType([f for f in docs.schema if f.name not in dropped] + [T.StructField(f"_{f.name}", f.dataType) for f in T._parse_datatype_string(DDL)])
    measured = written(docs.mapInArrow(apply, schema).withColumn("_lang", F.coalesce(F.col(lang_col), F.lit(""))))
    steps = written(_steps(measured))
    joined = measured.join(small(written(_quartiles(steps, "_lang").withColumnRenamed("_lang", "_of"))), F.col("_lang") == F.col("_of"), "left")
    joined = joined.join(F.broadcast(written(_script_distances(steps, rules))), F.col("_script") == F.col("_by"), "left")  # as many rows as scripts
    own = F.least(F.col("_rows") / F.lit(max(1, rules.least_rows)), F.lit(1.0))
    reach = rules.spread * (own * (F.col("_high") - F.col("_low")) + (1 - own) * F.col("_distance"))
    ordinary = F.coalesce(F.col("_chars_per_token").between(F.col("_low") - reach, F.col("_high") + reach), F.lit(True))
    return joined.withColumn("_kept", F.col("_kept") & ordinary)


def quality_measures(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: its id, the base counts, the verdict and the measures behind it."""
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    return _judged(chosen, rules, "text", "lang", ("text",)).select("doc_id", *(F.col(f"_{x}").alias(x) for x in MEASURES.names))


def keep_ordinary(docs: DataFrame, rules: Rules, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that pass, with all their columns as they are.

    Columns of docs whose names begin with an underscore and clash with those
    used in between are carried under other names.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text, lang = (f"c{docs.columns.index(x)}" for x in (text_col, lang_col))
    return _judged(plain, rules, text, lang).where("_kept").select(*(F.col(c).alias(x) for c, x in zip(plain.columns, docs.columns)))
