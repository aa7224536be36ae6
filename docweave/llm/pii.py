"""Personal data by a semi-Markov conditional random field.

Four kinds are known: email, ip, card, phone.  Base patterns find the plain
forms.  Other ways to write them (an address spelt with "at" and "dot", a
number without its country code, digits grouped otherwise) are segments that
a semi-Markov conditional random field scores as wholes.

A text is searched for places with enough digits, or with an at and a dot in
some spelling; each becomes a run of tokens, however long: entities may stand
side by side, with nothing but blanks or marks between them.  The field gives every
segment of a run, up to ``LONGEST`` tokens, a score for each kind from
features of the whole span: its shape, its digit groups, checksums and
ranges, and its neighbours.  A dynamic programme over the ends of segments
chooses the boundaries and kinds with the best sum; tokens outside entities
are segments of one token.  Base spans stay; the field's spans are added
where they overlap none.

The weights maximise the likelihood of generated, annotated runs: entities in
many spellings among numbers that are none (dates, versions, amounts, hashes,
orders).  Training takes the driver a few seconds and no corpus.

Each text is handled by itself, in one scan without a shuffle.  Null and empty
texts have no spans; repeated rows are each searched; other columns are not
read.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm._arrow import column, slices

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LONGEST = 17
_BLOCK = 1024  # tokens whose segments are held at a time

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
# A match can only begin where a run of digits begins: what fails there fails within it.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, in order."""
    spans, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in (y[-4:] if not y[:-4].strip("0") else "999" for y in m.group().split("."))):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                spans.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|[^\s]", re.ASCII)
_NUMBER = re.compile(r"[+(]{0,2}[0-9][0-9().\-/\x20]*[0-9]")
_AT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)"
_DOT = r"(?:\.|\s\.\s|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_NAME = rf"[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}"
# After a plain "at" the dots must be spelt too: "look at example.com" is no address.
_SPELT = re.compile(rf"{_NAME}(?:(?!\sat\s){_AT}[A-Za-z0-9-]{{1,64}}(?:{_DOT}[A-Za-z0-9-]{{1,64}}){{1,4}}|\sat\s[A-Za-z0-9-]{{1,64}}(?:(?![.]|\s[.]){_DOT}[A-Za-z0-9-]{{1,64}}){{1,4}})", re.IGNORECASE)
_ON = re.compile(rf"{_DOT}[A-Za-z0-9]", re.IGNORECASE)
_SPELT_MARKS = re.compile(r"[\[({ ]\s?dot\b|[\[({]\s?at\s?[\])}]|\s@|@\s", re.IGNORECASE)
_CUES = {
    0: frozenset("email mail e contact write courriel correo".split()),
    1: frozenset("ip host server address adresse".split()),
    2: frozenset("card visa mastercard credit carte karte tarjeta".split()),
    3: frozenset("phone tel call mobile fax telefon telefono cell".split()),
}


def regions(text: str) -> list[tuple[int, int]]:
    """Where the field looks: ranges of text with some context, apart from each other."""
    found = []
    if _DIGIT.search(text):
        found += [m.span() for m in _NUMBER.finditer(text) if sum("0" <= c <= "9" for c in m.group()) >= 7]
    if _SPELT_MARKS.search(text):
        found += [m.span() for m in _SPELT.finditer(text)]
    merged: list[list[int]] = []
    for a, z in sorted(found):
        a, z = max(0, a - 24), min(len(text), z + 8)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(z, merged[-1][1])
        else:
            merged.append([a, z])
    return [(a, z) for a, z in merged]


def _features(text: str, a: int, z: int) -> list[str]:
    """Features of a whole span, apart from its kind."""
    span = text[a:z]
    digits = _digits(span)
    out = ["bias"]
    before, after = text[a - 1 : a], text[z : z + 1]
    if before.isalnum() or before in ("_", '"', "=") and before:
        out.append("joined before")
    if after.isalnum() or after in ("_", '"') and after:
        out.append("joined after")
    if before in (".", "-", "/", "+", "@", "(") and before:
        out.append(f"before {before}")
    if after in ("-", "/", "@") and after or after == "." and text[z + 1 : z + 2].isalnum():
        out.append(f"after {after}")
    if span[0].isspace() or span[-1].isspace():
        out.append("blank edge")
    if span[-1] in ".,;:-/(+@" or span[0] in ".,;:-/)":
        out.append("mark at edge")
    letters = any(c.isalpha() for c in span)
    groups = [len(x) for x in re.findall(r"[0-9]+", span)]
    marks = {c for c in span if not c.isalnum()}
    if letters:
        out.append("letters")
        low = span.lower()
        at, dot = re.search(_AT, low), re.findall(_DOT, low)
        if at and dot:
            out.append("spelt address" if _SPELT.fullmatch(span) else "half an address")
            if _ON.match(text, z):
                out.append("goes on")
            if not re.search(r"[@\[({]", low) and not re.search(r"\sdot\s", low):
                out.append("plain words")
    else:
        out.append(f"digits {len(digits)}" if len(digits) < 20 else "digits many")
        out.append("shape " + ",".join(map(str, groups[:6])))
        if 10 <= len(digits) <= 13 and len(groups) >= 3 and marks <= set(" ()-."):
            out.append("phone groups")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append("checksum")
            if set(groups) == {4} or len(groups) == 1:
                out.append("checksum, even groups")
        if len(groups) == 4 and marks == {"."} and all(int(x) <= 255 for x in re.findall(r"[0-9]+", span) if len(x) < 5) and max(groups) <= 3:
            out.append("four octets")
        if "/" in marks or len(marks - set(" ()+")) > 1:
            out.append("mixed marks")
        if span.startswith("+"):
            out.append("plus")
        if re.match(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$", span):
            out.append("area code")
        if re.match(r"(19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.]", span) or re.search(r"[-/.](19|20)[0-9]{2}$", span):
            out.append("date")
    words = re.findall(r"[^\W\d_]+", text[max(0, a - 24) : a].lower())
    for kind, cues in _CUES.items():
        if words and cues & set(words[-2:]):
            out.append(f"cue {KINDS[kind]}")
    return out


class Field:
    """A semi-Markov conditional random field over the segments of a run of tokens."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights  # weights: features by kinds

    def lattice(self, text: str, begin: int, end: int) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
        """Token edges of text[begin:end], and its segments (first edge, last edge, feature indices) that can be entities."""
        edges = [begin, *(m.end() for m in _TOKEN.finditer(text, begin, end))]
        return edges, self.segments(text, edges, 0, len(edges) - 1)

    def segments(self, text: str, edges: list[int], first: int, last: int) -> list[tuple[int, int, list[int]]]:
        """The segments of a lattice that begin at the edges first to last - 1."""
        tokens = [text[a:z] for a, z in zip(edges[first:], edges[first + 1 : last + LONGEST])]
        n_digits = [len(x) if "0" <= x[0] <= "9" else 0 for x in tokens]
        blank = [x[0].isspace() for x in tokens]
        letter = [x[0].isalpha() for x in tokens]
        segments = []
        for i in range(first, last):
            if blank[i - first]:
                continue
            n, letters, at = 0, False, False
            for j in range(i + 1, min(len(edges), i + LONGEST + 1)):
                k = j - 1 - first
                n += n_digits[k]
                letters = letters or letter[k]
                at = at or letters or tokens[k] == "@"  # else no address is spelt
                if blank[k] or edges[j] - edges[i] < 7:
                    continue
                if not (7 <= n <= 19 and not letters) and not (at and _SPELT.fullmatch(text[edges[i] : edges[j]])):
                    continue
                segments.append((i, j, [self.names[f] for f in _features(text, edges[i], edges[j]) if f in self.names]))
        return segments

    def scores(self, segments: list) -> np.ndarray:
        return np.array([self.weights[f].sum(0) for _, _, f in segments]).reshape(-1, len(KINDS))

    def best(self, text: str, begin: int, end: int) -> list[tuple[int, int, int]]:
        edges = [begin, *(m.end() for m in _TOKEN.finditer(text, begin, end))]
        value, choice = [0.0] + [-np.inf] * (len(edges) - 1), [(-1, -1)] * len(edges)
        for first in range(0, len(edges) - 1, _BLOCK):  # runs may be of any length
            last = min(first + _BLOCK, len(edges) - 1)
            segments = self.segments(text, edges, first, last)
            scores = self.scores(segments)
            kinds = scores.argmax(1).tolist()
            s = 0
            for i in range(first, last):
                if i and value[i - 1] >= value[i]:
                    value[i], choice[i] = value[i - 1], (-1, -1)
                while s < len(segments) and segments[s][0] == i:
                    j, v = segments[s][1], value[i] + scores[s, kinds[s]]
                    if v > value[j]:
                        value[j], choice[j] = v, (i, kinds[s])
                    s += 1
        out, j = [], len(edges) - 1
        if j and value[j - 1] >= value[j]:
            choice[j] = (-1, -1)
        while j > 0:
            i, kind = choice[j]
            if i < 0:
                j -= 1
            else:
                out.append((edges[i], kind, edges[j]))
                j = i
        return out[::-1]


def _example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated run and its spans (start, kind, end)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))

    def card(ok: bool) -> str:
        while True:
            x = rng.choice("3456") + d(15)
            if luhn(x) == ok:
                return x

    def grouped(x: str, mark: str) -> str:
        return mark.join(x[i : i + 4] for i in range(0, len(x), 4))

    local, host = word() + rng.choice(["", "." + word(), d(2)]), word()
    at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" @ ", "."), (" [at] ", " [dot] ")])
    area, a, b = rng.choice("23456789") + d(2), d(3), d(4)
    kind, entity = rng.choice(
        [
            (0, local.replace(".", dot if rng.random() < 0.5 else ".") + at + host + dot + rng.choice(["com", "org", "net", "example" + dot + "com"])),
            (0, f"{local} @ {host}.com"),
            (1, ".".join(str(rng.randint(0, 255)) for _ in range(4))),
            (2, grouped(card(True), rng.choice(["", " ", "-", ".", "/"]))),
            (3, rng.choice([f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"+1 ({area}) {a}-{b}", f"1-{area}-{a}-{b}", f"+{rng.randint(20, 99)} {d(2)} {d(4)} {d(4)}", f"{area} {a} {b}"])),
            (NONE, f"{rng.randint(1900, 2099)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"),
            (NONE, f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/{rng.randint(1900, 2099)}"),
            (NONE, f"{rng.randint(1900, 2099)}{d(4)}"),
            (NONE, d(rng.choice([7, 8, 9, 10, 11, 12, 13, 14]))),
            (NONE, card(False)),
            (NONE, grouped(card(False), rng.choice([" ", "-", ""]))),
            (NONE, "".join(rng.choice("0123456789abcdef") for _ in range(30)) + "a" + d(9)),
            (NONE, f"{d(3)} {d(3)} {d(3)}"),
            (NONE, f"{rng.randint(1, 9)}.{d(2)}.{d(5)}"),
            (NONE, " ".join(d(rng.randint(1, 3)) for _ in range(5))),
            (NONE, f"{rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(300, 999)}"),
            (NONE, f"{word()} at {word()} . {word()} "),
        ]
    )
    cue = rng.choice(sorted(_CUES[kind])) + rng.choice([" ", ": "]) if kind < NONE and rng.random() < 0.3 else word() + " "
    if kind == NONE and rng.random() < 0.2:
        cue = rng.choice(["order ", "id ", "version ", "no. ", 'token = "'])
    tail = rng.choice([" " + word(), ". " + word().title(), ", " + word(), ".", "", '"' if '"' in cue else ""])
    text = cue + entity + tail
    return text, [] if kind == NONE else [(len(cue), kind, len(cue) + len(entity))]


@cache
def trained(examples: int = 900, rounds: int = 12, seed: int = 11) -> Field:
    """The field whose weights make the annotated runs likeliest, by stochastic gradient ascent with decay."""
    rng = random.Random(seed)
    made = [_example(rng) for _ in range(examples)]
    names: dict[str, int] = {}

    class _Growing(dict):
        def __contains__(self, key):
            self.setdefault(key, len(self))
            return True

    growing = _Growing()
    field = Field(growing, np.zeros((0, len(KINDS))))
    lattices = [(*field.lattice(text, 0, len(text)), spans) for text, spans in made]
    names.update(growing)
    w = np.zeros((len(names), len(KINDS)))
    total = np.zeros_like(w)
    for step in range(rounds):
        rate = 0.5 / (1 + step / 3)
        for edges, segments, spans in lattices:
            if not segments:
                continue
            scores = np.array([w[f].sum(0) for _, _, f in segments])
            n = len(edges)
            potential = np.exp(np.clip(scores, -30, 30))
            mass = potential.sum(1)
            forward, backward = np.zeros(n), np.zeros(n)
            forward[0] = backward[-1] = 1
            ends: list[list[int]] = [[] for _ in range(n)]
            begins: list[list[int]] = [[] for _ in range(n)]
            for s, (i, j, _) in enumerate(segments):
                ends[j].append(s)
                begins[i].append(s)
            for j in range(1, n):
                forward[j] = forward[j - 1] + sum(forward[segments[s][0]] * mass[s] for s in ends[j])
            for i in range(n - 2, -1, -1):
                backward[i] = backward[i + 1] + sum(mass[s] * backward[segments[s][1]] for s in begins[i])
            truth = {(a, z): kind for a, kind, z in spans}
            for s, (i, j, f) in enumerate(segments):
                gradient = -forward[i] * backward[j] / forward[-1] * potential[s]
                if (kind := truth.get((edges[i], edges[j]))) is not None:
                    gradient[kind] += 1
                w[f] += rate * gradient
        w *= 0.995
        total += w
    return Field(names, w)


def spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    added = []
    for begin, end in regions(text):
        for a, kind, z in field.best(text, begin, end):
            if not any(x < z and a < y for x, _, y in base):
                added.append((a, kind, z))
    return base, sorted(base + added)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{z}" for a, kind, z in found)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base counts by kind, base_sha256, spans, and the spans that the field added."""
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    model = trained()
    names, weights = model.names, model.weights

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(names, weights)
        for part in slices(batches, "text"):
            rows = []
            for text in column(part, "text").to_pylist():
                base, every = spans(text or "", field)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4]), pa.array(columns[5]), pa.array(columns[6], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return chosen.mapInArrow(apply, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in angle brackets, overlapping spans by the first; null stays null."""
    model = trained()
    names, weights = model.names, model.weights
    schema = docs.schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(names, weights)
        for part in slices(batches, text_col):
            out = []
            for text in column(part, text_col).to_pylist():
                if text is None:
                    out.append(None)
                    continue
                pieces, at = [], 0
                for a, kind, z in spans(text, field)[1]:
                    if a >= at:
                        pieces += [text[at:a], f"<{KINDS[kind]}>"]
                        at = z
                    else:
                        at = max(at, z)
                out.append("".join([*pieces, text[at:]]))
            at = part.schema.get_field_index(text_col)
            yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    return docs.mapInArrow(apply, schema)
