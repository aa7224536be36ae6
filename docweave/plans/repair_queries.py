"""Repairs by content: page tables and texts, and the boundaries of chunks, over documents made of parts."""

from __future__ import annotations

import base64
import json
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import chunking, enrichment, passes
from docweave.plans import synthetic
from docweave.plans.parse_queries import _ORDER_ROWS
from docweave.sources import evidence, layout
from docweave.sources.registry import default_readers
from docweave.sources.spread import spread


def grid(rows: list[list[str | None]], x: int = 50, y: int = 300, wide: int = 100, tall: int = 20, missing: tuple = ()) -> dict:
    """A table of even cells; a None has no box, its left neighbour's reaches over it."""
    out = []
    for i, row in enumerate(rows):
        boxes: list[list[int] | None] = []
        for j, text in enumerate(row):
            if text is None and j and boxes[-1] is not None:
                boxes[-1][2] += wide
                boxes.append(None)
            else:
                boxes.append([x + wide * j, y + tall * i, x + wide * (j + 1), y + tall * (i + 1)])
        out.append({"cells": boxes, "texts": [t or "" for t in row]})
    return {"bbox": [x, y, x + wide * len(rows[0]), y + tall * len(rows)], "rows": out}


def said(lines: list[str], top: int = 40) -> list[dict]:
    """The characters of lines of text, six points wide, fourteen apart."""
    return [{"text": c, "x0": 50 + 6 * i, "x1": 55 + 6 * i, "top": top + 14 * k, "bottom": top + 14 * k + 10} for k, line in enumerate(lines) for i, c in enumerate(line)]


def page(tables: list[dict] = (), lines: list[str] = (), **more) -> dict:
    return {"width": 600, "height": 900, "chars": said(lines), "tables": list(tables), **more}


def _parts(spark, sf_dir: str) -> DataFrame:
    return spread(synthetic.table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", "p_name", "p_brand", "p_type", "p_size"))


def _read(spark, sf_dir: str, build, readers: dict | None = None) -> DataFrame:
    return evidence.read(_parts(spark, sf_dir), readers or default_readers(), (".pages.json", lambda r: json.dumps({"pages": build(r)}).encode()))


def _tables(r: dict) -> list[dict]:
    """Pages whose table needs a repair, by the document's number."""
    key, name, brand, kind, code = str(r["doc_id"]), r["p_name"], r["p_brand"], r["p_type"], f"{r['p_size']:02}"
    case = r["doc_id"] % 8
    if case == 0:  # rows that go on from the one before, and one that begins an item of its own
        return [page([grid([["no", "item", "note"], [key, "- " + name, brand], ["", "", kind], ["", "and more", ""], ["", "- second", code]])])]
    if case == 1:  # a header in two rows: one label over two columns, one over a blank
        return [page([grid([["name", "measure", None], ["", "size", "type"], [name, code, kind]])])]
    if case == 2:  # contents that lost numbers and pages, which the page's lines have
        return [page([grid([["번호", "제목", "페이지"], ["", name, ""], ["", "annex " + brand, ""]])], [f"1 {name} {code}", f"2 annex {brand} 99"])]
    if case == 3:  # parallel lists of codes and actions
        return [page([grid([["분류", "코드", "행위명"], [brand, f"A{code} / B{code}", f"{name} / {kind}"], ["one", "C1", "alone"]])])]
    if case == 4:  # a first row of codes becomes a header
        return [page([grid([["질병코드", ""], [f"A{code}", f"B{code}.1"], [name, brand]])])]
    if case == 5:  # a table that goes on over the page, its last row too
        heads = ["key", "item", "note"]
        return [page([grid([heads, [key, name, brand]])]), page([grid([heads, ["", "", "more " + kind], [key, "last", code]], y=40)])]
    if case == 6:  # blank columns at the end, letters spaced out, lines within cells
        return [page([grid([["가 나 다", "second", "", ""], [f"{name}\n{brand}", "한글\n자", "", ""]])])]
    return [page([grid([["구분", "EDI코드"], ["기본 단순 초음파 일반", "EB401 EB402"], ["진단 두경부", "EB411 EB412"], ["진단 경부", "EB414 EB415"]])])]


def page_table_repairs(spark, sf_dir):
    found = evidence.cells(evidence.units(_read(spark, sf_dir, _tables)))
    return found.select("doc_id", "id", "section", "row_index", "column_id", "text", "rowspan", "colspan")


def page_table_labels(spark, sf_dir):
    """Columns by name, and what the table says of itself."""
    units = evidence.units(_read(spark, sf_dir, _tables)).where("type = 'table'")
    labels = F.from_json("content", "columns array<struct<text: string>>")["columns"]["text"]
    return units.select("doc_id", "id", F.array_join(labels, "|").alias("labels"), F.element_at(F.split("source_text", "\n"), -1).alias("last_line"))


def _nested(r: dict) -> list[dict]:
    """A cell with two tables: the second goes on with the first's header, with a header that is data, or stands for itself."""
    name, size, case = r["p_name"], r["p_size"], r["doc_id"] % 3
    outer = {"bbox": [50, 100, 450, 400], "rows": [{"cells": [[50, 100, 150, 120], [150, 100, 450, 120]], "texts": ["part", "tables"]}, {"cells": [[50, 120, 150, 400], [150, 120, 450, 400]], "texts": [name, "x"]}]}
    heads = [["k", "v"], [f"{size}1", f"{size}2"], ["other", "things"]][case]
    return [page([outer, grid([["k", "v"], ["a", name]], 160, 140), grid([heads, ["b", str(size)]], 160, 240)])]


def page_nested_tables(spark, sf_dir):
    nodes = evidence.nodes(evidence.units(_read(spark, sf_dir, _nested)))
    return nodes.select("doc_id", "node", F.coalesce("parent", F.lit("")).alias("parent"), "depth", "type", "n_rows", "n_columns")


def _texts(r: dict) -> list[dict]:
    """Pages of text alone, which a rule takes apart or leaves whole."""
    key, name, brand, kind = str(r["doc_id"]), r["p_name"], r["p_brand"], r["p_type"]
    lines = [
        [f"보건복지부 고시 제2020-{key}호", f"{name} first", f"{brand} said 다.", "2020년 1월 2일", "보건복지부 장관"],
        ["수신자 " + brand, "제목 " + name, f"1. {name} begins", "and goes on", f"2. {kind}", "붙임 " + key],
        [f"□ {name}", f"- {brand} one", "goes on", f"- {kind} two", f"□ {brand}", "the end of it all."],
        [f"{name} title", f"{brand} below"],
        ["a lead " + name, "관련 근거", f"개정 '20.1.2. 고시 제2020-{key}호 (2020.1.3. 시행) {name}", f"개정 '21.3.4. {brand}", f"* {kind} note", "goes on"],
        [f"INSID.{key}"],
        [f"A sentence of {name}.", f"- {key} -", f"{key}", f"It ends with {brand}."],
        [f"보건복지부 수신자 {brand} 주무관 {name} 시행 {key} 전화 {kind}"],
    ][r["doc_id"] % 8]
    return [page(lines=lines)]


def page_text_parts(spark, sf_dir):
    units = evidence.units(_read(spark, sf_dir, _texts))
    rows = F.from_json("content", "rows array<struct<cells: array<struct<text: string>>>>")["rows"]
    table = F.array_join(F.flatten(F.transform(rows, lambda x: F.transform(x["cells"], lambda c: c["text"]))), "|")
    return units.select("doc_id", "id", "type", F.when(F.col("type") == "table", table).otherwise(F.col("content")).alias("said"))


def _pictures(r: dict) -> list[dict]:
    """Pages that are a picture: with no text, with damaged text, or with enough of its own."""
    image = [{"x0": 0, "top": 0, "x1": 580, "bottom": 880}]
    own = [[], ["#%&* !!~~ ^^()= $$##@@ " * 3], [f"Enough text of its own: {r['p_name']} by {r['p_brand']}, to be read."]][r["doc_id"] % 3]
    return [page(lines=own, images=image)] * (1 + r["doc_id"] % 2)


def _seen(_: bytes, number: int) -> str:
    """What is read from the picture of a page."""
    if number:
        return "name  size\nred ring  7\nblue bolt  8\n"
    return "Before it\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n- 5 -\nafter it"


def page_pictures(spark, sf_dir):
    reader = {".pages.json": lambda data: layout.parse_json(data, _seen)}
    found = _read(spark, sf_dir, _pictures, reader)
    rows = F.from_json("content", "columns array<struct<text: string>>, rows array<struct<cells: array<struct<text: string>>>>")
    cells = F.array_join(F.concat(rows["columns"]["text"], F.flatten(F.transform(rows["rows"], lambda x: F.transform(x["cells"], lambda c: c["text"])))), "|")
    units = evidence.units(found).select("doc_id", F.col("ord"), F.col("type").alias("kind"), F.when(F.col("type") == "table", cells).otherwise(F.col("content")).alias("said"))
    return units.union(evidence.warnings(found).select("doc_id", F.col("ord") + 100, F.lit("warning"), F.col("type")))


def _drawn(r: dict) -> list[dict]:
    """Boxes in a row with lines between neighbours, every other one an arrow; every third document has no lines and so no diagram."""
    n = 2 + r["doc_id"] % 3
    chars, rects, lines = [], [], []
    for i in range(n):
        x = 40 + 140 * i
        rects.append({"x0": x, "top": 300, "x1": x + 100, "bottom": 340})
        chars += [{**c, "x0": c["x0"] - 45 + x, "x1": c["x1"] - 45 + x} for c in said([f"{'abcd'[i]} {r['p_size']}"], 315)]
        if i:
            lines.append({"x0": x - 40, "top": 320, "x1": x, "bottom": 320, "arrow": i % 2 == 1})
    return [page() | {"chars": chars, "rects": rects, "lines": lines if r["doc_id"] % 3 else []}]


def page_diagrams(spark, sf_dir):
    found = _read(spark, sf_dir, _drawn)
    edges = F.from_json("content", "edges array<struct<from: string, to: string, type: string, confidence: string>>")["edges"]
    told = F.array_join(F.transform(edges, lambda e: F.concat_ws(" ", e["from"], e["to"], e["type"], e["confidence"])), ",")
    units = evidence.units(found).select("doc_id", F.col("type").alias("kind"), "source_text", F.coalesce(told, F.lit("")).alias("edges"))
    return units.union(evidence.warnings(found).select("doc_id", F.lit("warning"), "type", F.lit("")))


def _illustrated(r: dict) -> list[dict]:
    """An image beside a table or within one of its cells, or one too small to count."""
    where = [[50, 500, 200, 600], [155, 325, 245, 385], [50, 500, 80, 530]][r["doc_id"] % 3]
    image = dict(zip(("x0", "top", "x1", "bottom"), where)) | {"data": base64.b64encode(PNG + r["p_name"].encode()).decode()}
    return [page([grid([["key", "picture"], [r["p_brand"], "shown"]], tall=100)], images=[image])]


PNG = b"\x89PNG\r\n\x1a\n"


def page_images(spark, sf_dir):
    found = _read(spark, sf_dir, _illustrated)
    nodes = evidence.nodes(evidence.units(found)).select("doc_id", "node", "type", F.coalesce("asset_id", F.lit("")).alias("detail"))
    held = evidence.assets(found).select("doc_id", "id", F.concat(F.lit("asset "), "mime"), F.sha2("data", 256))
    return nodes.union(held).union(evidence.warnings(found).select("doc_id", F.lit("warning"), "type", "severity"))


# Chunks of groups of sixteen parts


def _members(spark, sf_dir: str, line: str) -> DataFrame:
    """A text unit per member of a group; line says what it holds, by its place k from 1."""
    rows = synthetic.members(spark, sf_dir).selectExpr("cast(n_regionkey AS long) AS doc_id", "cast(n_nationkey % 16 + 1 AS int) AS k", "n_name").selectExpr("doc_id", "k AS ord", "concat('b', k) AS id", f"{line} AS line")
    common = F.to_json(F.struct(F.struct(F.lit("text").alias("chunk_kind"), F.array().cast("array<string>").alias("section_path"), F.lit("plain").alias("display_format")).alias("common")))
    return rows.select("doc_id", "ord", "id", F.lit("text").alias("type"), F.lit("plain").alias("format"), F.col("line").alias("source_text"), F.col("line").alias("content"), F.array().cast("array<string>").alias("section_path"), common.alias("metadata"))


def _whole(window: list[dict], most: int) -> list[dict]:
    return [{"operations": [{"unit_id": u["id"]} for u in window]}]


def _told(chunks: DataFrame) -> DataFrame:
    said = F.from_json(F.get_json_object("metadata", "$._warnings"), "array<struct<type:string,split_group_index:int,split_group_count:int,reason:string>>")
    last = F.element_at(said, -1)
    return chunks.select("doc_id", "ord", F.array_join("unit_ids", " ").alias("unit_ids"), "source_text", F.coalesce(last["type"], F.lit("")).alias("warning"), F.coalesce(last["split_group_index"], F.lit(0)).alias("part"), F.coalesce(last["split_group_count"], F.lit(0)).alias("parts"))


_CASE = "if(k % 4 = 1, concat('사례 ', k, ': ', n_name), n_name)"
_FORM = "if(k % 5 = 1, concat('[별지 제', k, '호 서식] ', n_name), if(k % 5 = 4, '210mm×297mm(일반용지 60g/㎡)', n_name))"
_HEAD = "if(k % 2 = 0, concat('가. ', n_name), n_name)"


def chunk_cases(spark, sf_dir):
    return _told(chunking.chunks(_members(spark, sf_dir, _CASE), plan=_whole))


def chunk_forms(spark, sf_dir):
    return _told(chunking.chunks(_members(spark, sf_dir, _FORM), plan=_whole))


def chunk_unit_limits(spark, sf_dir):
    return _told(chunking.chunks(_members(spark, sf_dir, "n_name"), chunking.Limits(units=6), plan=_whole))


def _pairs(window: list[dict], most: int) -> list[dict]:
    return [{"operations": [{"unit_id": u["id"]} for u in window[i : i + 2]]} for i in range(0, len(window), 2)]


def chunk_headings(spark, sf_dir):
    return _told(chunking.chunks(_members(spark, sf_dir, _HEAD), plan=_pairs))


def _decide(left: dict, right: dict, most: int) -> dict:
    """Merges at every other boundary of windows; fails at some."""
    at = int(right["metadata"]["source_unit_ids"][0][1:])
    if at == 13:
        raise RuntimeError("no answer")
    return {"action": "merge" if at in (5, 9) else "keep", "title": "joined", "reason": f"at {at}"}


def chunk_merges(spark, sf_dir):
    """Windows of four: the first two become one chunk, the third is too much for it, the fourth has no decision."""
    rows = chunking.chunks(_members(spark, sf_dir, "n_name"), chunking.Limits(units=10, window=4), plan=_whole, decide=_decide)
    merges = F.from_json(F.get_json_object("metadata", "$._boundary_merges"), "array<struct<reason:string>>")
    return _told(rows).join(rows.select("doc_id", "ord", F.coalesce(F.get_json_object("metadata", "$.title"), F.lit("")).alias("title"), F.coalesce(F.array_join(merges["reason"], ","), F.lit("")).alias("reasons")), ["doc_id", "ord"])


def table_pieces(spark, sf_dir):
    """Tables of orders cut by a small token budget: each piece's rows and text."""
    limits = chunking.Limits(target_tokens=1, most_tokens=2)
    rows = passes.chunks(synthetic.order_pages(spark, sf_dir), default_readers(), limits, columns=("doc_id", "ord", "source_text", "metadata"))
    return rows.select("doc_id", "ord", "source_text", F.get_json_object("metadata", "$.operations[0].row_ranges").alias("rows"))


def _told_of(chunk: dict) -> tuple[int, dict]:
    """What a service answers, from nothing but what it is told; every third answer has no question."""
    told = enrichment.payload(chunk)
    key, table = int(told["id"].split("/")[0]), told["evidence"][0]["table"]
    summary = f"  {table['caption']} of {len(table['rows'])}:  {table['rows'][-1]['cells'][1]['text']} by {table['columns'][1]} "
    return key, {"id": told["id"], "summary": summary, "keywords": ["a", "a", " ", f"k{key}"], "questions": [f"what is {key}", f"what is {key}?"] if key % 3 else []}


def _answered(chunks: list[dict]) -> dict:
    """All at once, but for some that are left out."""
    return {"chunks": [said for key, said in map(_told_of, chunks) if key % 5]}


def _answered_singly(chunk: dict) -> dict:
    key, said = _told_of(chunk)
    if key % 10 == 0:
        raise RuntimeError(f"no answer for {key}")
    return said


def chunk_answers(spark, sf_dir):
    """Chunks filled in by a service, in batches, singly where a batch leaves one out, and by rules where there is no answer."""
    fill = partial(enrichment.filled, call=_answered_singly, batch=_answered, budget=3_000)
    rows = passes.chunks(synthetic.order_pages(spark, sf_dir), default_readers(), fill=fill, columns=("doc_id", "id", "summary", "keywords", "questions", "metadata"))
    said = F.from_json(F.get_json_object("metadata", "$._warnings"), "array<struct<type:string,reason:string>>")
    failed = F.coalesce(F.get(said, F.lit(0))["reason"], F.lit(""))
    return rows.select("doc_id", "id", failed.alias("failed"), *(F.when(failed == "", c).otherwise("").alias(n) for n, c in (("summary", F.col("summary")), ("keywords", F.array_join("keywords", " ")), ("questions", F.array_join("questions", " ")))))


QUERIES = {f.__name__: f for f in (chunk_answers, page_table_repairs, page_table_labels, page_nested_tables, page_text_parts, page_pictures, page_diagrams, page_images, chunk_cases, chunk_forms, chunk_unit_limits, chunk_headings, chunk_merges, table_pieces)}

_P = "p AS (SELECT p_partkey AS d, p_partkey::VARCHAR AS key, p_partkey % 8 AS c, p_name AS name, p_brand AS brand, p_type AS kind, p_size, lpad(p_size::VARCHAR, 2, '0') AS code FROM part)"


def _cell_rows(case: int, heads: list[tuple], body: list[list[tuple]], unit: str = "b1") -> list[str]:
    """SELECTs of cells (column, SQL of text, rowspan, colspan); heads is a list of rows too."""
    return [f"SELECT d AS doc_id, '{unit}' AS id, '{section}' AS section, {i}::INT AS row_index, 'c{col}' AS column_id, {text} AS text, {tall}::INT AS rowspan, {wide}::INT AS colspan FROM p WHERE c = {case}" for section, rows in (("header", heads), ("body", body)) for i, row in enumerate(rows, 1) for col, text, tall, wide in row]


def _plain(*texts: str) -> list[tuple]:
    return [(i, t, 1, 1) for i, t in enumerate(texts, 1)]


_TABLE_SQL = [
    *_cell_rows(0, [_plain("'no'", "'item'", "'note'")], [_plain("key", "'- ' || name || chr(10) || 'and more'", "brand || chr(10) || kind"), _plain("''", "'- second'", "code")]),
    *_cell_rows(1, [[(1, "'name'", 2, 1), (2, "'measure'", 1, 2)], [(2, "'size'", 1, 1), (3, "'type'", 1, 1)]], [_plain("name", "code", "kind")]),
    *_cell_rows(2, [_plain("'번호'", "'제목'", "'페이지'")], [_plain("'1'", "name", "code"), _plain("'2'", "'annex ' || brand", "'99'")], "b3"),
    *_cell_rows(3, [_plain("'분류'", "'코드'", "'행위명'")], [_plain("brand", "'A' || code", "name"), _plain("''", "'B' || code", "kind"), _plain("'one'", "'C1'", "'alone'")]),
    *_cell_rows(4, [[(1, "'질병코드'", 1, 2)], _plain("'A' || code", "'B' || code || '.1'")], [_plain("name", "brand")]),
    *_cell_rows(5, [_plain("'key'", "'item'", "'note'")], [_plain("key", "name", "brand || chr(10) || 'more ' || kind"), _plain("key", "'last'", "code")]),
    *_cell_rows(6, [_plain("'가나다'", "'second'")], [_plain("name || ' ' || brand", "'한글자'")]),
    *_cell_rows(7, [[(1, "'구분'", 1, 2), (3, "'EDI코드'", 1, 1)]], [[(1, "'기본 초음파'", 2, 1), (2, "'단순'", 1, 1), (3, "'EB401'", 1, 1)], [(2, "'일반'", 1, 1), (3, "'EB402'", 1, 1)], [(1, "'진단 초음파'", 2, 1), (2, "'안구'", 1, 1), (3, "'EB411'", 1, 1)], [(2, "'안와'", 1, 1), (3, "'EB412'", 1, 1)], [(1, "'진단 초음파'", 2, 1), (2, "'갑상선·부갑상선'", 1, 1), (3, "'EB414'", 1, 1)], [(2, "'갑상선·부갑상선 제외한 경부'", 1, 1), (3, "'EB415'", 1, 1)]]),
]

_M = "m AS (SELECT n_regionkey::BIGINT AS doc_id, n_nationkey % 16 + 1 AS k, n_name FROM nation)"
_CHUNKED = """, u AS (SELECT doc_id, k, 'b' || k AS id, {line} AS line, {group} AS g, max(k) OVER (PARTITION BY doc_id) AS n FROM m),
    c AS (SELECT doc_id, g, string_agg(id, ' ' ORDER BY k) AS unit_ids, string_agg(line, chr(10) || chr(10) ORDER BY k) AS source_text FROM u GROUP BY doc_id, g),
    o AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY g))::INT AS ord, (count(*) OVER (PARTITION BY doc_id))::INT AS parts FROM c)
    SELECT doc_id, ord, unit_ids, source_text, {warning} AS warning, {part}::INT AS part, {parts}::INT AS parts FROM o"""


def _chunked(line: str, group: str, kind: str) -> str:
    split = "parts > 1"
    return synthetic.grouped_sql(f"WITH {_M}" + _CHUNKED.format(line=line, group=group, warning=f"CASE WHEN {split} THEN '{kind}' ELSE '' END", part=f"CASE WHEN {split} THEN ord ELSE 0 END", parts=f"CASE WHEN {split} THEN parts ELSE 0 END"))


ORACLES = {
    "page_table_repairs": f"WITH {_P} " + " UNION ALL ".join(_TABLE_SQL),
    "page_table_labels": f"""WITH {_P} SELECT d AS doc_id, CASE c WHEN 2 THEN 'b3' ELSE 'b1' END AS id,
        CASE c WHEN 0 THEN 'no|item|note' WHEN 1 THEN 'name|measure / size|measure / type' WHEN 2 THEN '번호|제목|페이지' WHEN 3 THEN '분류|코드|행위명' WHEN 4 THEN '질병코드 / A' || code || '|질병코드 / B' || code || '.1' WHEN 5 THEN 'key|item|note' WHEN 6 THEN '가나다|second' ELSE '구분|구분|EDI코드' END AS labels,
        CASE c WHEN 0 THEN 'row 2: item: - second; note: ' || code WHEN 1 THEN 'row 1: name: ' || name || '; measure / size: ' || code || '; measure / type: ' || kind WHEN 2 THEN 'row 2: 번호: 2; 제목: annex ' || brand || '; 페이지: 99' WHEN 3 THEN 'row 3: 분류: one; 코드: C1; 행위명: alone'
        WHEN 4 THEN 'row 1: 질병코드 / A' || code || ': ' || name || '; 질병코드 / B' || code || '.1: ' || brand WHEN 5 THEN 'row 2: key: ' || key || '; item: last; note: ' || code WHEN 6 THEN 'row 1: 가나다: ' || name || ' ' || brand || '; second: 한글자' ELSE 'row 6: 구분 [2]: 갑상선·부갑상선 제외한 경부; EDI코드: EB415' END AS last_line FROM p""",
    "page_nested_tables": """WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 3 AS c FROM part)
        SELECT doc_id, 'b1' AS node, '' AS parent, 0 AS depth, 'table' AS type, 1 AS n_rows, 2 AS n_columns FROM p
        UNION ALL SELECT doc_id, 'b1.1', 'b1', 1, 'table', CASE c WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END, 2 FROM p UNION ALL SELECT doc_id, 'b1.2', 'b1', 1, 'table', 1, 2 FROM p WHERE c = 2""",
    "page_text_parts": f"""WITH {_P}, t(c, i, x) AS (SELECT c, 0, '' FROM p WHERE false)
        SELECT d AS doc_id, 'b' || i AS id, CASE WHEN c = 4 AND i = 2 THEN 'table' ELSE 'text' END AS type, x AS said FROM p, LATERAL (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT CASE c
        WHEN 0 THEN ['보건복지부 고시 제2020-' || key || '호', name || ' first ' || brand || ' said 다.', '2020년 1월 2일', '보건복지부 장관']
        WHEN 1 THEN ['수신자 ' || brand, '제목 ' || name, '1. ' || name || ' begins and goes on', '2. ' || kind, '붙임 ' || key]
        WHEN 2 THEN ['□ ' || name, '- ' || brand || ' one goes on' || chr(10) || '- ' || kind || ' two', '□ ' || brand, 'the end of it all.']
        WHEN 3 THEN [name || ' title', brand || ' below']
        WHEN 4 THEN ['a lead ' || name, '개정 ''20.1.2.|고시 제2020-' || key || '호|2020.1.3. 시행|' || name || '|개정 ''21.3.4.|||' || brand, '* ' || kind || ' note', 'goes on']
        WHEN 5 THEN []
        WHEN 6 THEN ['A sentence of ' || name || '.' || chr(10) || 'It ends with ' || brand || '.']
        ELSE ['보건복지부', '수신자 ' || brand, '주무관 ' || name, '시행 ' || key, '전화 ' || kind] END AS l))""",
    "page_pictures": """WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 3 AS c, p_partkey % 2 AS two, 'Enough text of its own: ' || p_name || ' by ' || p_brand || ', to be read.' AS own FROM part),
        v(c, second, ord, kind, said) AS (VALUES (0, 0, 1, 'text', 'Before it'), (0, 0, 2, 'table', 'a|b|1|2|3|4'), (0, 0, 3, 'text', 'after it'), (0, 1, 4, 'table', 'name|size|red ring|7|blue bolt|8'))
        SELECT doc_id, ord, kind, said FROM p JOIN v ON v.c = 0 AND p.c < 2 AND second <= two
        UNION ALL SELECT doc_id, 1 + s, 'text', own FROM p, (VALUES (0), (1)) AS x(s) WHERE c = 2 AND s <= two
        UNION ALL SELECT doc_id, (100 + row_number() OVER (PARTITION BY doc_id ORDER BY a))::INT, 'warning', w FROM p, (VALUES (1, 1, 0, 'pdf_native_text_ocr_fallback'), (2, 0, 0, 'pdf_ocr_table_inferred'), (3, 1, 1, 'pdf_native_text_ocr_fallback'), (4, 0, 1, 'pdf_ocr_table_inferred')) AS y(a, damaged, s, w) WHERE c < 2 AND s <= two AND damaged <= c""",
    "chunk_answers": f"""WITH r AS ({_ORDER_ROWS}), o AS (SELECT doc_id, count(*) AS n, arg_max(l_partkey, row_index) AS part FROM r GROUP BY 1)
        SELECT doc_id, 'chunk-1' AS id, CASE WHEN doc_id % 10 = 0 THEN 'no answer for ' || doc_id ELSE '' END AS failed, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'Lines of ' || n || ': ' || part || ' by part' END AS summary,
        CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'a k' || doc_id END AS keywords,
        CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'Lines 표에는 어떤 항목이 포함되어 있나요? Lines 표의 주요 기준이나 값은 무엇인가요?' ELSE 'what is ' || doc_id || '?' END AS questions FROM o""",
    "page_diagrams": """WITH p AS (SELECT p_partkey AS doc_id, p_size, 2 + p_partkey % 3 AS n FROM part WHERE p_partkey % 3 > 0), b AS (SELECT *, unnest(range(1, n + 1)) AS i FROM p),
        w AS (SELECT doc_id, string_agg(substr('abcd', i::INT, 1) || ' ' || p_size, chr(10) ORDER BY i) AS names, string_agg('n' || (i - 1) || ' -> n' || i, chr(10) ORDER BY i) FILTER (i > 1) AS ties,
        string_agg('n' || (i - 1) || ' n' || i || CASE WHEN i % 2 = 0 THEN ' arrow' ELSE ' line' END || ' inferred_geometry', ',' ORDER BY i) FILTER (i > 1) AS edges FROM b GROUP BY doc_id)
        SELECT doc_id, 'diagram' AS kind, names || chr(10) || 'relations:' || chr(10) || ties AS source_text, edges FROM w UNION ALL SELECT doc_id, 'warning', 'pdf_diagram_inferred', '' FROM w
        UNION ALL SELECT p_partkey, 'text', 'a ' || p_size || ' b ' || p_size, '' FROM part WHERE p_partkey % 3 = 0""",
    "page_images": """WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 3 AS c, sha256(from_hex('89504E470D0A1A0A') || encode(p_name)) AS sha FROM part)
        SELECT doc_id, 'b1' AS node, 'table' AS type, '' AS detail FROM p UNION ALL SELECT doc_id, CASE c WHEN 0 THEN 'b2' ELSE 'b1.1' END, 'image', 'img-0001' FROM p WHERE c < 2
        UNION ALL SELECT doc_id, 'img-0001', 'asset image/png', sha FROM p WHERE c < 2 UNION ALL SELECT doc_id, 'warning', 'pdf_table_cell_image_inferred', 'low' FROM p WHERE c = 1""",
    "chunk_cases": _chunked("CASE WHEN k % 4 = 1 THEN '사례 ' || k || ': ' || n_name ELSE n_name END", "(k - 1) // 4", "agentic_case_boundary_split"),
    "chunk_forms": _chunked("CASE WHEN k % 5 = 1 THEN '[별지 제' || k || '호 서식] ' || n_name WHEN k % 5 = 4 THEN '210mm×297mm(일반용지 60g/㎡)' ELSE n_name END", "2 * ((k - 1) // 5) + (k % 5 = 0)::INT", "agentic_independent_form_boundary_split"),
    "chunk_unit_limits": _chunked("n_name", "(k - 1) // 6", "agentic_chunk_split_by_max_units"),
    "chunk_headings": synthetic.grouped_sql(f"""WITH {_M}, u AS (SELECT doc_id, k, CASE WHEN k % 2 = 0 THEN '가. ' || n_name ELSE n_name END AS line, max(k) OVER (PARTITION BY doc_id) AS n FROM m),
        g AS (SELECT *, CASE WHEN (k + 1) // 2 < (n + 1) // 2 AND k % 2 = 0 THEN k // 2 + 1 ELSE (k + 1) // 2 END AS g, (n + 1) // 2 AS last FROM u)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g))::INT AS ord, string_agg('b' || k, ' ' ORDER BY k) AS unit_ids, string_agg(line, chr(10) || chr(10) ORDER BY k) AS source_text,
        CASE WHEN any_value(last) = 1 THEN '' WHEN g = any_value(last) THEN 'agentic_heading_moved_forward' ELSE 'agentic_trailing_heading_removed' END AS warning, 0 AS part, 0 AS parts FROM g GROUP BY doc_id, g"""),
    "chunk_merges": synthetic.grouped_sql(f"""WITH {_M}, u AS (SELECT *, CASE WHEN k <= 8 THEN 0 ELSE (k - 1) // 4 END AS g, max(k) OVER (PARTITION BY doc_id) AS n FROM m)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g))::INT AS ord, string_agg('b' || k, ' ' ORDER BY k) AS unit_ids, string_agg(n_name, chr(10) || chr(10) ORDER BY k) AS source_text,
        CASE WHEN g = 0 AND any_value(n) > 10 THEN 'agentic_boundary_merge_exceeds_max_units' WHEN g = 2 AND any_value(n) > 12 THEN 'agentic_boundary_merge_failed' ELSE '' END AS warning, 0 AS part, 0 AS parts,
        CASE WHEN g = 0 AND any_value(n) > 4 THEN 'joined' ELSE '' END AS title, CASE WHEN g = 0 AND any_value(n) > 4 THEN 'at 5' ELSE '' END AS reasons FROM u GROUP BY doc_id, g"""),
    "table_pieces": f"""WITH r AS ({_ORDER_ROWS}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, 'line: ' || l_linenumber || '; part: ' || l_partkey || '; quantity: ' || l_quantity::INT || '; flag: ' || l_returnflag AS said FROM r)
        SELECT doc_id, row_index AS ord, CASE WHEN n = 1 THEN 'section: Order ' || doc_id || chr(10) || 'caption: Lines' || chr(10) || 'columns: line | part | quantity | flag' || chr(10) || 'row 1: ' || replace(said, ': ', '=')
        ELSE 'table rows: ' || row_index || chr(10) || 'context: Order ' || doc_id || ' | Lines | columns: c1: line; c2: part; c3: quantity; c4: flag' || chr(10) || 'row ' || row_index || ': ' || said END AS source_text,
        CASE WHEN n > 1 THEN '[[' || row_index || ',' || row_index || ']]' END AS "rows" FROM n""",
}
