"""Table grids: headers, column labels and source text.

A grid cell is (row, column, rowspan, colspan, text, children), addresses
from 0.  Formats differ in a few rules, which are arguments here.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class GridCell:
    row: int
    column: int
    rowspan: int = 1
    colspan: int = 1
    text: str = ""
    children: list[dict] = field(default_factory=list)

    @property
    def end(self) -> int:
        return self.column + self.colspan

    @property
    def filled(self) -> bool:
        return bool(self.text.strip() or self.children)


Row = list[GridCell]


def width(rows: list[Row]) -> int:
    return max((c.end for r in rows for c in r), default=0)


def refines(row: Row, above: Row, contained: bool) -> bool:
    """Whether each wide, filled cell above has a filled cell of row within it; with contained, row has no filled cell elsewhere."""
    groups = [c for c in above if c.colspan > 1 and c.text.strip()]
    if not groups or any(c.children for c in row):
        return False
    inside = lambda c, g: g.column <= c.column and c.end <= g.end
    texts = [c for c in row if c.text.strip()]
    if contained and not all(any(inside(c, g) for g in groups) for c in texts):
        return False
    return all(any(inside(c, g) for c in texts) for g in groups)


def header_rows(rows: list[Row], blank_extends: bool = True, contained: bool = True) -> int:
    """How many first rows head the table: the first, and those that begin within its spans, are blank, or refine the row above.

    Without blank_extends a blank row counts only if the row after it refines
    the one before it.
    """
    if not rows or any(c.children for c in rows[0]):
        return 0
    count, end = 1, max((c.row + c.rowspan for c in rows[0]), default=0)
    while count < len(rows):
        row = rows[count]
        blank = not any(c.filled for c in row)
        if blank and not blank_extends:
            blank = count + 1 < len(rows) and refines(rows[count + 1], rows[count - 1], contained)
        if not (min((c.row for c in row), default=0) < end or blank or refines(row, rows[count - 1], contained)):
            break
        end = max(end, max((c.row + c.rowspan for c in row), default=0))
        count += 1
    return count


def column_label(heads: list[Row], column: int, single_row_spreads: bool = True) -> str:
    """The distinct texts above a column, outermost first; a wide cell counts for all its columns unless it is in the last header row (or, where that spreads, in the only one)."""
    last, texts = len(heads) - 1, []
    for i, row in enumerate(heads):
        spreads = i < last or (single_row_spreads and last == 0)
        for c in row:
            if c.column == column or (c.column < column < c.end and spreads):
                if (text := c.text.strip()) and text not in texts:
                    texts.append(text)
    return " / ".join(texts)


def content(rows: list[Row], heads: int, single_row_spreads: bool = True, caption: str | None = None) -> dict:
    """The structured form of a grid."""
    columns = [{"id": f"c{i + 1}", "text": column_label(rows[:heads], i, single_row_spreads)} for i in range(width(rows))]

    def shown(some: list[Row]) -> list[dict]:
        return [{"index": n, "cells": [{"column_id": f"c{c.column + 1}", "text": c.text, "rowspan": c.rowspan, "colspan": c.colspan, "children": c.children} for c in sorted(r, key=lambda c: c.column)]} for n, r in enumerate(some, 1)]

    out = {"caption": caption, "columns": columns, "rows": shown(rows[heads:])}
    if heads:
        out["header_rows"] = shown(rows[:heads])
    return out


def lone_text(table: dict) -> str | None:
    """The text of a table that is one header cell and nothing else."""
    heads = table.get("header_rows", [])
    if table["rows"] or len(heads) != 1 or len(heads[0]["cells"]) != 1 or heads[0]["cells"][0]["children"]:
        return None
    return heads[0]["cells"][0]["text"].strip() or None


def is_meaningful(label: str) -> bool:
    return bool(label) and not label.startswith("col ")


def _base(label: str) -> str:
    return re.sub(r"^(.+) \[\d+\]$", r"\1", label)


def common_prefix(labels: list[str]) -> str | None:
    """What the labels of several columns begin with, by " / " parts."""
    if len(labels) < 2 or not all(map(is_meaningful, labels)):
        return None
    shared = []
    for parts in zip(*(_base(x).split(" / ") for x in labels)):
        if len(set(parts)) > 1:
            break
        shared.append(parts[0])
    return " / ".join(shared) or None


def group_label(labels: list[str]) -> str | None:
    """The distinct first parts of several columns' labels."""
    if len(labels) < 2 or not all(map(is_meaningful, labels)):
        return None
    return " / ".join(dict.fromkeys(g for x in labels if (g := _base(x).split(" / ")[0]))) or None


def source_labels(columns: list[dict], rows: list[dict] | None) -> dict[str, str]:
    """Labels by column id; those that two filled cells of one row would share are numbered."""
    labels = {c["id"]: str(c["text"]).strip() or f"col {int(c['id'][1:])}" for c in columns}
    often = Counter(x for x in labels.values() if is_meaningful(x))
    if rows is None:
        unclear = {x for x, n in often.items() if n > 1}
    else:
        unclear = set()
        for row in rows:
            seen = Counter(labels.get(c["column_id"]) for c in row["cells"] if c["colspan"] == 1 and (c["text"] or c["children"]))
            unclear |= {x for x, n in seen.items() if n > 1 and x is not None and often[x] > 1}
    count: Counter = Counter()
    out = {}
    for column, label in labels.items():
        if label in unclear:
            count[label] += 1
            label = f"{label} [{count[label]}]"
        out[column] = label
    return out


def cell_label(cell: dict, labels: dict[str, str], by_header: bool, group_falls_back: bool = False) -> str:
    """A cell's label: what its columns share, or its place."""
    first, n = int(cell["column_id"][1:]), cell["colspan"]
    if by_header:
        own = [labels.get(f"c{k}", f"col {k}") for k in range(first, first + n)]
        shared = common_prefix(own)
        if shared is None and (len(set(own)) == 1 or n == 1) and is_meaningful(own[0]):
            shared = own[0]
        if shared is None and group_falls_back:
            shared = group_label(own)
        if shared is not None:
            return shared
    return f"col {first}" if n <= 1 else f"cols {first}-{first + n - 1}"


def source_text(table: dict, describe: Callable[[dict], str] | None = None, group_falls_back: bool = False) -> str:
    """A line for each row, cells labelled; describe puts a nested diagram into words."""
    labels = source_labels(table["columns"], table["rows"])

    def child(c: dict) -> str:
        inner = c["content"]
        if c["type"] == "table":
            return "nested table: " + source_text(inner, describe, group_falls_back).replace("\n", " / ")
        if c["type"] == "image":
            return f"image: {inner['asset_id']}"
        return "diagram: " + (describe(inner) if describe else "").replace("\n", " / ")

    lines = [f"table: {len(table['columns'])} columns"] if table["columns"] else []
    for name, rows in (("header", table.get("header_rows", [])), ("row", table["rows"])):
        for row in rows:
            values = []
            for c in row["cells"]:
                said = "; ".join(x for x in (c["text"], *map(child, c["children"])) if x)
                if said:
                    values.append(f"{cell_label(c, labels, name == 'row', group_falls_back)}: {said}")
            if values:
                lines.append(f"{name} {row['index']}: {'; '.join(values)}")
    return "\n".join(lines)


def normalized(rows: list[Row], n_rows: int, n_columns: int) -> list[Row]:
    """Every slot of an n_rows by n_columns grid covered: spans cut where another cell begins or the grid ends, blanks put in."""
    taken: dict[tuple[int, int], GridCell] = {}
    starts = {(c.row, c.column) for r in rows for c in r}
    out: list[Row] = [[] for _ in range(n_rows)]
    for c in sorted((c for r in rows for c in r), key=lambda c: (c.row, c.column)):
        if c.row >= n_rows or c.column >= n_columns or (c.row, c.column) in taken:
            continue
        tall, wide = min(c.rowspan, n_rows - c.row), min(c.colspan, n_columns - c.column)
        for k in range(1, wide):
            if (c.row, c.column + k) in taken or (c.row, c.column + k) in starts:
                wide = k
                break
        for k in range(1, tall):
            if any((c.row + k, c.column + j) in starts for j in range(wide)):
                tall = k
                break
        kept = GridCell(c.row, c.column, tall, wide, c.text, c.children)
        for i in range(tall):
            for j in range(wide):
                taken[c.row + i, c.column + j] = kept
        out[c.row].append(kept)
    for i in range(n_rows):
        out[i] += [GridCell(i, j) for j in range(n_columns) if (i, j) not in taken]
        out[i].sort(key=lambda c: c.column)
    return out


def compacted(table: dict, least_columns: int = 10, least_cells: int = 50, least_blank: float = 0.5) -> dict:
    """A wide, mostly blank table without its blank cells, and how many went."""
    cells = [c for key in ("header_rows", "rows") for r in table.get(key, []) for c in r["cells"]]
    blank = [c for c in cells if not c["text"].strip() and not c["children"]]
    if len(table["columns"]) < least_columns or len(cells) < least_cells or len(blank) < least_blank * len(cells):
        return table
    keep = lambda rows: [{**r, "cells": [c for c in r["cells"] if c["text"].strip() or c["children"]]} for r in rows]
    out = {**table, "rows": keep(table["rows"]), "compact": {"omitted_blank_cells": len(blank)}}
    if "header_rows" in table:
        out["header_rows"] = keep(table["header_rows"])
    return out


def any_of(value: Any, default: int) -> int:
    try:
        return int(float(value))
    except (TypeError, ValueError):
        return default
