"""Texts of page layouts: cleaning, tables in plain lines, and notices, letters, sections and revision lists taken apart."""

from __future__ import annotations

import re

from docweave.operators import page_tables

_PAGE_NUMBER = re.compile(r"^[^\S\n]*(?:-[^\S\n]*)?\d+(?:[^\S\n]*-)?[^\S\n]*$", re.M)
_REVISION = [re.compile(x) for x in (r"개정\s+[’']?\d{2,4}(?:\.\d{1,2}){2}\.", r"\s+고시\s+제\d{4}-\d+호", r"\s+\([^)]*시행\)")]
_NUMBERED = re.compile(r"\d+\.\s+")
_ITEM = re.compile(r"[■□○〇\-ㆍ․*※]|\d+\.\s|\(?\d+\)|[가-힣]\.\s|제\d+조(의\d+)?[(]")


def clean(text: str | None) -> str:
    """Without page numbers and blank lines, each line stripped."""
    return "\n".join(x for line in _PAGE_NUMBER.sub("", text or "").splitlines() if (x := line.strip()))


def is_artifact(text: str) -> bool:
    return re.fullmatch(r"INSID[\w:.-]+", text.strip(), re.ASCII) is not None


def _flowed(lines: list[str]) -> str:
    return " ".join(lines).replace("세부 사항", "세부사항").strip()


def notice(lines: list[str]) -> list[str] | None:
    """A ministry's notice: its paragraphs end in 다., dates and signatures stand alone."""
    if not "".join(lines[:1]).startswith("보건복지부 고시 "):
        return None
    out, held = [lines[0]], []
    for x in lines[1:]:
        alone = re.fullmatch(r"\d{4}년(?:\s+\d{1,2}[월일]){2}", x) or x == "보건복지부 장관" or x.endswith("일부개정")
        if not alone:
            held.append(x)
        if held and (alone or x.endswith("다.")):
            out.append(_flowed(held))
            held = []
        if alone:
            out.append(x)
    return [*out, *([_flowed(held)] if held else [])]


def letter(lines: list[str]) -> list[str] | None:
    """An official letter: addressee, subject, numbered paragraphs, enclosures."""
    if not all(any(fits(x) for x in lines) for fits in (lambda x: x.startswith("수신자"), lambda x: x.startswith("제목"), _NUMBERED.match)):
        return None
    out, held = [], []
    for x in lines:
        if _NUMBERED.match(x) or x.startswith(("붙임", '"긴급지원', "수신자", "제목")) or x in ("보건복지부", "(경유)"):
            if held:
                out.append(_flowed(held))
            held = [x] if _NUMBERED.match(x) else []
            if not held:
                out.append(x)
        elif held:
            held.append(x)
        else:
            out.append(x)
    return [*out, *([_flowed(held)] if held else [])]


def letter_end(lines: list[str]) -> list[str] | None:
    """The last lines of a letter, cut before each of their fields."""

    def cut(line: str) -> list[str]:
        at = sorted(i for m in "수신자 주무관 주주관 주관 시행 접수 우 전화".split() if (i := line.find(f" {m} ")) > 0)
        return [p for a, z in zip([0, *(i + 1 for i in at)], [*at, len(line)]) if (p := line[a:z].strip())]

    if lines[:1] == ["보건복지부"] and "".join(lines[1:2]).startswith("수신자"):
        return [p for x in lines for p in cut(x)]
    if len(lines) == 1 and lines[0].startswith("보건복지부 수신자 ") and " 시행 " in lines[0] and " 전화 " in lines[0]:
        return cut(lines[0])
    return None


def related(lines: list[str]) -> list[str] | None:
    return lines if len(lines) >= 3 and lines[1] == "1. 관련 근거" and all(x.startswith("○") for x in lines[2:]) else None


def is_section_head(x: str) -> bool:
    return x.startswith(("□", "개정 ")) or x in ("일반사항", "⋮") or (x.endswith("Q&A") and (len(x) <= 60 or x[0] == "「")) or (x[0] == "<" and x[-1] == ">")


def sectioned(lines: list[str]) -> list[str] | None:
    if len(lines) < 2 or not any(map(is_section_head, lines)):
        return None
    out: list[str] = []
    held: list[list[str]] = []

    def flush() -> None:
        if held:
            out.append("\n".join(map(_flowed, held)))
            held.clear()

    for x in lines:
        if is_section_head(x):
            flush()
            out.append(x)
        elif not held or _ITEM.match(x):
            held.append([x])
        else:
            held[-1].append(x)
    flush()
    return out


def short_heads(lines: list[str]) -> list[str] | None:
    return lines if 2 <= len(lines) <= 3 and all(len(x) <= 40 and not x.endswith(".") for x in lines) else None


def text_parts(text: str) -> list[str] | None:
    """What the first of the rules that applies makes of a text."""
    lines = [x for line in text.splitlines() if (x := line.strip())]
    for rule in (letter, letter_end, notice, related, sectioned, short_heads):
        found = rule(lines)
        if found and len(found) > 1:
            return found
    return None


def revision_parts(text: str) -> list[tuple[str, object]] | None:
    """A list of two or more amendments under 관련 근거 as a table, with the texts around it."""
    lines = [x for line in text.splitlines() if (x := line.strip())]
    if "관련 근거" not in lines:
        return None
    at = lines.index("관련 근거")
    rows = []
    for x in lines[at + 1 :]:
        if not _REVISION[0].match(x):
            break
        values = []
        for pattern in _REVISION:  # day, notice, day of effect, each where it is given
            m = pattern.match(x)
            values.append(m[0].strip().strip("()") if m else "")
            x = x[m.end() :] if m else x
        rows.append([*values, x.strip()])
    if len(rows) < 2:
        return None
    heads = ["개정일", "고시", "시행일", "관련 근거"]
    table = page_tables.from_lines(rows, heads)
    table["header_rows"] = [{"index": 1, "cells": [page_tables.simple(f"c{i}", h) for i, h in enumerate(heads, 1)]}]
    tail: list[list[str]] = []
    for x in lines[at + 1 + len(rows) :]:
        if x.startswith(("*", "※")) or not tail or tail[-1][0].startswith("*"):
            tail.append([x])
        else:
            tail[-1].append(x)
    return [*(("text", x) for x in lines[:at]), ("table", table), *(("text", page_tables.joined_cjk("\n".join(x))) for x in tail)]


def pipe_cells(line: str) -> list[str]:
    return [x.strip() for x in line.strip().strip("|").split("|")]


def aligned_cells(line: str) -> list[str]:
    return [x.strip() for x in re.split(r"\t+| {2,}", line.strip())]


def read_parts(text: str) -> list[tuple[str, object]]:
    """Text that was read from a picture as paragraphs and tables, drawn with bars or aligned by gaps."""
    lines = text.splitlines()
    out: list[tuple[str, object]] = []
    held: list[str] = []
    is_pipe = lambda x: x.strip()[:1] == x.strip()[-1:] == "|" and x.count("|") >= 3
    is_rule = lambda x: is_pipe(x) and all(re.fullmatch(":?-{3,}:?", c) for c in pipe_cells(x))

    def aligned(i: int) -> int:
        cells = aligned_cells(lines[i]) if i < len(lines) else []
        return len(cells) if len(cells) >= 2 and all(cells) else 0

    def flush() -> None:
        body = clean("\n".join(held))
        held.clear()
        if body:
            out.append(("text", body))

    i = 0
    while i < len(lines):
        if i + 2 < len(lines) and is_pipe(lines[i]) and is_rule(lines[i + 1]) and is_pipe(lines[i + 2]):
            flush()
            j = i + 2
            while j < len(lines) and is_pipe(lines[j]):
                j += 1
            out.append(("table_pipe", page_tables.from_lines([pipe_cells(x) for x in lines[i + 2 : j]], pipe_cells(lines[i]))))
            i = j
        elif aligned(i) and aligned(i + 1) == aligned(i):
            flush()
            n, j = aligned(i), i + 1
            while j < len(lines) and len(aligned_cells(lines[j])) == n:
                j += 1
            out.append(("table_text", page_tables.from_lines([aligned_cells(x) for x in lines[i + 1 : j]], aligned_cells(lines[i]))))
            i = j
        else:
            held.append(lines[i])
            i += 1
    flush()
    return out or [("text", text)]
