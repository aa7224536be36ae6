"""Operators on small inputs."""

import hashlib
import json

import pytest

from docweave.functions import plain, ranges, text
from docweave.operators import assets, chunking, diagrams, enrichment, grid, page_tables, page_texts, rendering, scan
from docweave.plans.index import index
from docweave.sources import chat, evidence, html
from docweave.streaming import files


def text_unit(name, said, **common):
    return {"type": "text", "id": name, "content": said, "format": "plain", "source": {"text": said, "kind": "text"}, "metadata": {"common": {"section_path": [], **common}}}


def table_unit(name, n, spanning=False, words="b{}"):
    rows = []
    for k in range(1, n + 1):
        first = {"column_id": "c1", "text": f"a{k}", "rowspan": n if spanning else 1, "colspan": 1, "children": []}
        second = {"column_id": "c2", "text": words.format(k), "rowspan": 1, "colspan": 1, "children": []}
        rows.append({"index": k, "cells": [second] if spanning and k > 1 else [first, second]})
    content = {"rows": rows, "caption": None, "columns": [{"id": f"c{i}", "text": x} for i, x in enumerate("AB", 1)]}
    return {"type": "table", "id": name, "content": content, "format": "structured_table", "source": {"text": "T", "kind": "table"}, "metadata": {"common": {"section_path": ["S"]}}}


def ids(chunks):
    return [c["metadata"]["source_unit_ids"] for c in chunks]


def kinds(chunk):
    return [w["type"] for w in chunk["metadata"].get("_warnings", [])]


HARD = ["", " \t\n ", "plain", "a b\x1cc", "두 글자 x1 _y", "1. head", "가. x", "[별지 제3호 서식] name", "[별지 제3호서식] <2020 삭 제>", "○ 사례 2 x", "(뒤 쪽)", "210mm × 297mm 일반용지", "x" * 500, "One. Two! 三。 Four", "\n\n first \nsecond", "Q?", "why.."]


def test_columns_agree_with_plain_rules(spark):
    from pyspark.sql import functions as F

    c = F.col("x")
    pairs = {
        "flat": (text.normalize_space(c), plain.flat),
        "tokens": (text.estimated_tokens(c), plain.tokens),
        "keywords": (text.keywords(c), plain.keywords),
        "kept": (text.keywords_without_stops(c), lambda x: plain.keywords(x, plain.STOPS)),
        "clipped": (text.clipped(c, 20), lambda x: plain.clipped(x, 20)),
        "clean": (text.clipped_clean(c, 20), lambda x: plain.clipped_clean(x, 20)),
        "line": (text.first_line(c, 100), plain.first_line),
        "topic": (text.topic(c), plain.topic),
        "sentence": (text.first_sentence(c), plain.first_sentence),
        "summary": (text.flat_summary(c), plain.flat_summary),
        "question": (text.clean_question(c), plain.clean_question),
        "about": (text.question_about(c), lambda x: plain.question_about(x)[0]),
        "heading": (text.looks_like_heading(c), plain.is_heading),
        "deleted": (text.is_deleted_form(c), plain.is_deleted_form),
        "form": (text.starts_form(c), plain.starts_form),
        "case": (text.starts_case(c), plain.starts_case),
        "end": (text.ends_form(c), plain.ends_form),
        "back": (text.is_back_page(c), plain.is_back_page),
    }
    rows = spark.createDataFrame([(x,) for x in HARD], "x string").select("x", *(col.alias(name) for name, (col, _) in pairs.items())).collect()
    for r in rows:
        for name, (_, rule) in pairs.items():
            assert r[name] == rule(r["x"]), (name, r["x"])


def test_scalars(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        text.chat_url(F.lit("http://x/v1/")).alias("url"),
        text.mime_of(F.lit(b"\x89PNG\r\n\x1a\n.")).alias("mime"),
        text.public_url(F.lit("s3://b/a b/ü.png"), "https://h/p").alias("public"),
        ranges.label(ranges.contiguous(F.array(F.lit(3), F.lit(1), F.lit(2), F.lit(7)))).alias("runs"),
        text.suffix(F.lit("HTM")).alias("suffix"),
    ).first()
    assert tuple(row) == ("http://x/v1/chat/completions", "image/png", "https://h/p/b/a%20b/%C3%BC.png", "1-3, 7", ".htm")


def test_fallback_covers_every_unit_once():
    units = [text_unit(f"b{i}", f"unit {i}.") for i in range(95)]
    made = chunking.chunk_document(units)
    assert [x for own in ids(made) for x in own] == [u["id"] for u in units] and made[-1]["id"] == "chunk-95"
    assert made[0]["metadata"]["_fallback_reason"] == "chunk plan must be a list"


def test_rows_left_out_are_repaired_and_spans_carried():
    unit = table_unit("b1", 4, spanning=True)
    made = chunking.chunk_document([unit, text_unit("b2", "x")], plan=lambda w, n: [{"operations": [{"unit_id": "b1", "action": "include_rows", "row_ranges": [[2, 3]]}]}])
    assert [[o.get("row_ranges") for o in c["metadata"].get("operations", [{}])] for c in made] == [[[[1, 1], [4, 4]]], [[[2, 3]]], [None]]
    first = made[1]["evidence"]["items"][0]["content"]["rows"][0]["cells"][0]
    assert (first["text"], first["rowspan"], first["metadata"]["rowspan_context"]) == ("a1", 2, {"source_row_index": 1, "source_rowspan": 4})


@pytest.mark.parametrize(
    "plan, reason",
    [
        ([{"operations": [{"unit_id": "zz"}]}], "unknown unit id: 'zz'"),
        ([{"operations": [{"unit_id": "b1"}]}, {"operations": [{"unit_id": "b1"}]}], "duplicate unit id: b1"),
        ([{"operations": [{"unit_id": "b3", "action": "include_rows", "row_ranges": [[1, 2], [2, 3]]}]}], "include_rows ranges overlap for unit: b3"),
        ([{"operations": []}], "chunk plan item requires operations"),
        ([{"operations": [{"unit_id": "b1"}], "context_unit_ids": ["b2"]}], "context unit id must refer to a prior assigned unit: b2"),
        ([{"operations": [{"unit_id": "b1", "action": "drop"}]}], "unsupported action: 'drop'"),
        ("no", "chunk plan must be a list"),
    ],
)
def test_broken_plans_fall_back(plan, reason):
    units = [text_unit("b1", "x"), text_unit("b2", "y"), table_unit("b3", 3)]
    made = chunking.chunk_document(units, plan=lambda w, n: plan)
    assert len(made) == 3 and made[0]["metadata"]["_fallback_reason"] == reason


def test_plans_are_repaired_with_warnings():
    units = [text_unit("b1", "x"), table_unit("b2", 3)]
    plan = [{"unit_ids": ["b2"], "title": "t", "operations": [{"unit_id": "b1"}, {"unit_id": "b2"}, {"unit_id": "b2", "action": "include_rows", "row_ranges": [[1, 1]]}]}]
    assert kinds(chunking.chunk_document(units, plan=lambda w, n: plan)[0]) == ["agentic_plan_include_rows_ignored", "agentic_plan_unit_ids_mismatch"]
    bad = [{"operations": [{"unit_id": "b1"}]}, {"operations": [{"unit_id": "b2", "action": "include_rows", "row_ranges": [[1, 99]]}]}]
    assert kinds(chunking.chunk_document(units, plan=lambda w, n: bad)[1]) == ["agentic_include_rows_repaired_to_full_include"]


def test_windows_merge_at_their_boundary():
    units = [text_unit(f"b{i}", f"unit {i}.") for i in range(4)]
    by_unit = lambda w, n: [{"operations": [{"unit_id": u["id"]}]} for u in w]
    limits = chunking.Limits(window=2)
    made = chunking.chunk_document(units, limits, by_unit, lambda a, b, n: {"action": "merge", "reason": "one"})
    assert ids(made) == [["b0"], ["b1", "b2"], ["b3"]]
    assert kinds(chunking.chunk_document(units, limits, by_unit, lambda a, b, n: 1 / 0)[1]) == ["agentic_boundary_merge_failed"]
    assert kinds(chunking.chunk_document(units, chunking.Limits(1, window=2), by_unit, lambda a, b, n: {"action": "merge"})[1]) == ["agentic_boundary_merge_exceeds_max_units"]


def test_headings_move_to_what_they_head():
    units = [text_unit("b1", "body."), text_unit("b2", "1. One"), text_unit("b3", "2. Two"), text_unit("b4", "more.")]
    each = lambda w, n: [{"operations": [{"unit_id": u["id"]}]} for u in w]
    assert ids(chunking.chunk_document(units, plan=each)) == [["b1"], ["b2", "b3", "b4"]]
    assert ids(chunking.chunk_document(units[:3], plan=each)) == [["b1"], ["b2", "b3"]]


def test_cases_forms_and_unit_limits_split():
    whole = lambda w, n: [{"operations": [{"unit_id": u["id"]} for u in w]}]
    cases = [text_unit("b1", "intro."), text_unit("b2", "○ 사례 1 x"), text_unit("b3", "y."), text_unit("b4", "사례 2: z")]
    assert ids(chunking.chunk_document(cases, plan=whole)) == [["b1"], ["b2", "b3"], ["b4"]]
    forms = [text_unit("b1", "[별지 제1호서식] form"), text_unit("b2", "body."), text_unit("b3", "[별지 제2호서식] other"), text_unit("b4", "body 210mm×297mm 일반용지"), text_unit("b5", "after.")]
    assert ids(chunking.chunk_document(forms, plan=whole)) == [["b1", "b2"], ["b3", "b4"], ["b5"]]
    many = [text_unit(f"b{i}", f"unit {i}.") for i in range(5)]
    made = chunking.chunk_document(many, chunking.Limits(units=2), whole)
    assert ids(made) == [["b0", "b1"], ["b2", "b3"], ["b4"]] and kinds(made[0]) == ["agentic_chunk_split_by_max_units"]


def test_large_tables_are_cut_by_rows():
    unit = table_unit("b2", 30, words="word{0} " * 20)
    unit["source"]["text"] = chunking.table_text(unit["content"])
    made = chunking.chunk_document([text_unit("b1", "before."), unit], chunking.Limits(target_tokens=200, most_tokens=300), lambda w, n: [{"operations": [{"unit_id": "b1"}, {"unit_id": "b2"}]}])
    cut = [r for c in made for i in c["evidence"]["items"] if i["type"] == "table" for r in i["metadata"]["row_ranges"]]
    assert [k for a, z in cut for k in range(a, z + 1)] == list(range(1, 31))
    assert ids(made)[0] == ["b1", "b2"] and made[0]["source"]["text"].splitlines()[1] == "context: before. | S | columns: c1: A; c2: B"


def test_enrichment_by_rules_and_callables():
    chunk = chunking.chunk_document([text_unit("b1", "First one. Second table word.")])[0]
    made = enrichment.enriched(chunk)
    assert made["summary"] == "First one." and made["keywords"] == ["First", "one", "Second", "word"] and made["metadata"]["_enrichment"]["method"] == "heuristic"
    assert enrichment.enriched(chunk, lambda c: {"summary": " s  t ", "questions": ["why"], "keywords": []})["questions"] == ["why?"]
    failed = enrichment.enriched(chunk, lambda c: 1 / 0)
    assert kinds(failed) == ["rag_chunk_enrichment_failed"] and failed["summary"] == "First one."
    kept = enrichment.enriched({**chunk, "metadata": {**chunk["metadata"], "_needs_enrichment": False}}, lambda c: [])
    assert kept["metadata"]["_enrichment"]["method"] == "preserved"


def test_batches_hold_to_their_budget():
    many = chunking.chunk_document([text_unit(f"b{i}", "word " * (600 if i == 2 else 5)) for i in range(5)])
    sizes = [len(b) for b in enrichment.batches_of(many, 800)]
    assert sum(sizes) == 5 and 1 in sizes
    done = enrichment.enriched_batch(many, lambda cs: {"chunks": [{"id": c["id"], "summary": "S"} for c in cs]}, enrichment.by_rules)
    assert {c["summary"] for c in done} == {"S"}
    assert enrichment.enriched_batch(many, lambda cs: {"chunks": []}, enrichment.by_rules)[0]["metadata"]["_enrichment"]["method"] == "llm"


def test_grids():
    cells = [grid.GridCell(0, 0, 1, 2, "G"), grid.GridCell(1, 0, text="a"), grid.GridCell(1, 1, text="b"), grid.GridCell(2, 0, 3, 1, "x"), grid.GridCell(2, 1, text="y"), grid.GridCell(3, 0, text="cut")]
    rows = grid.normalized([cells], 4, 3)
    assert [[(c.column, c.text, c.rowspan) for c in r] for r in rows] == [[(0, "G", 1), (2, "", 1)], [(0, "a", 1), (1, "b", 1), (2, "", 1)], [(0, "x", 1), (1, "y", 1), (2, "", 1)], [(0, "cut", 1), (1, "", 1), (2, "", 1)]]
    assert grid.header_rows(rows) == 2
    columns = [{"id": f"c{i}", "text": t} for i, t in enumerate(("P / a", "P / b", "Q", "Q"), 1)]
    assert grid.common_prefix(["P / a", "P / b"]) == "P" and grid.group_label(["P / a", "Q"]) == "P / Q"
    both = [{"cells": [{"column_id": c, "text": "v", "colspan": 1, "children": []} for c in ("c3", "c4")]}]
    assert list(grid.source_labels(columns, both).values()) == ["P / a", "P / b", "Q [1]", "Q [2]"]
    assert list(grid.source_labels(columns, []).values()) == ["P / a", "P / b", "Q", "Q"]
    wide = grid.content([[grid.GridCell(r, c, text="h" if r == 0 else "") for c in range(12)] for r in range(6)], 1)
    assert grid.compacted(wide)["compact"] == {"omitted_blank_cells": 60}


def test_diagram_rules():
    nodes = [{"text": "① go"}, {"text": "on"}, {"text": "(note)"}, {"text": "② then ③ last"}]
    assert diagrams.step_labels(nodes, diagrams.split_steps) == ["① go\non", "② then", "③ last"]
    assert diagrams.nearest({"x": 5, "y": 0}, [("a", (0, 0, 2, 2)), ("b", (8, 0, 2, 2))]) == "a"
    flow = diagrams.table_flow([("처리절차", 0, 0, 3, 1), ("A", 0, 1, 1, 1), ("→ (go)", 1, 1, 1, 1), ("B", 2, 1, 1, 1)])
    assert [(e["from"], e["to"], e["label"]) for e in flow["edges"]] == [("n2", "n3", "go")]


def test_page_rules():
    assert page_tables.cell_text("가 나 다\nx") == "가나다 x" and page_tables.header_depth([["g", "", ""], ["a", "b", "c"]]) == 2
    assert page_tables.columns([["g", ""], ["a", "b"]], 2) == [{"id": "c1", "text": "g / a"}, {"id": "c2", "text": "g / b"}]
    table = {"columns": [{"id": f"c{i}", "text": t} for i, t in enumerate(("분류", "코드", "행위명"), 1)], "rows": [{"index": 1, "cells": [page_tables.simple("c1", "k"), page_tables.simple("c2", "1\n2"), page_tables.simple("c3", "x / y")]}]}
    page_tables.expand_parallel(table)
    assert [[c["text"] for c in r["cells"]] for r in table["rows"]] == [["k", "1", "x"], ["", "2", "y"]]
    assert page_texts.clean(" a \n- 12 -\n\n b") == "a\nb" and page_texts.is_artifact("INSID1:2")
    parts = page_texts.revision_parts("머리\n관련 근거\n개정 ’20.1.2. 고시 제2020-1호 (2020 시행) 뒤\n개정 2021.3.4.\n* 끝")
    assert [k for k, _ in parts] == ["text", "table", "text"] and [c["text"] for c in parts[1][1]["rows"][0]["cells"]] == ["개정 ’20.1.2.", "고시 제2020-1호", "2020 시행", "뒤"]
    assert page_texts.text_parts("□ 하나\n둘\n- 셋") == ["□ 하나", "둘\n- 셋"]


def page_table_of(heads, rows):
    table = page_tables.from_lines(rows, heads)
    table["header_rows"] = [{"index": 1, "cells": [page_tables.simple(f"c{i}", h) for i, h in enumerate(heads, 1)]}]
    return table


def test_page_table_promotions():
    contents = page_table_of(["번호", "제목", "페이지"], [["", "첫 장", ""], ["2", "둘째", "9"]])
    page_tables.repair(contents, "1 첫장 3\n2 둘째 9\nother")
    assert [[c["text"] for c in r["cells"]] for r in contents["rows"]] == [["1", "첫 장", "3"], ["2", "둘째", "9"]]
    codes = page_table_of(["질병코드", "", ""], [["A00", "B01.2", "C10~C12"], ["x", "y", "z"]])
    page_tables.repair(codes)
    assert [c["text"] for c in codes["columns"]] == ["질병코드 / A00", "질병코드 / B01.2", "질병코드 / C10~C12"] and len(codes["rows"]) == 1 and codes["header_rows"][0]["cells"][0]["colspan"] == 3
    scans = page_table_of(["구분", "EDI코드"], [["단일 기본 초음파 복합", "EB401 EB402"], ["진단 초음파 눈 주위", "EB411 EB412"], ["a 특수 초음파 b c", "EB901 EB902"]])
    page_tables.repair(scans)
    assert [[c["text"] for c in r["cells"]] for r in scans["rows"]] == [["기본 초음파", "단일", "EB401"], ["복합", "EB402"], ["진단 초음파", "안구", "EB411"], ["안와", "EB412"], ["특수 초음파", "a", "EB901"], ["b c", "EB902"]]
    assert scans["rows"][0]["cells"][0]["rowspan"] == 2


def test_assets_are_put_and_resolved(spark, tmp_path):
    page = b"<table><tr><th>a</th></tr><tr><td><img src='data:image/png;base64,aGk='></td></tr></table>"
    docs = spark.createDataFrame([(1, ".html", page)], "doc_id long, suffix string, content binary")
    made = index(docs, put=assets.folder_sink(str(tmp_path)))
    sha = hashlib.sha256(page).hexdigest()
    content = json.loads(made.units.first().content)
    assert (tmp_path / sha / "assets" / "img-0001.png").read_bytes() == b"hi"
    child = content["rows"][0]["cells"][0]["children"][0]
    assert child["content"]["uri"].endswith(f"{sha}/assets/img-0001.png") and child["content"]["bytes"] == 2
    assert "img-0001" in made.pages().first().html
    with pytest.raises(assets.UnknownAsset):
        assets.resolve({"type": "image", "format": "asset_ref", "content": {"asset_id": "zz"}}, {})


def test_pages_are_escaped_and_spans_clipped():
    unit = html.parse(b"<table><tr><th>a</th><th>b</th></tr><tr><td rowspan=3>&lt;x&gt;</td><td>1</td></tr><tr><td>2</td></tr></table>").units
    page = rendering.units_page(unit)
    assert "&lt;x&gt;" in page and 'rowspan="2"' in page and "<x>" not in page
    assert rendering.layout_of({"nodes": [{"id": "n1", "text": "a", "shape_type": "label"}], "edges": []}) == "labels"
    assert rendering.routes(["① go", "A", "(note)", "② on", "B"]) == [("route", ["① go"], ["A"]), ("note", ["(note)"], []), ("route", ["② on"], ["B"])]
    made = chunking.chunk_document([text_unit("b1", "x & y.")])
    assert "fallback: chunk plan must be a list" in rendering.chunks_page(made)


def test_chat_retries_and_reads_loose_json():
    import urllib.error

    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)
        return "done"

    service = chat.Chat("http://x", "m")
    assert chat.persistent(call, service, waits.append) == "done" and waits == [0.5, 1.0] and service.endpoint == "http://x/v1/chat/completions"
    with pytest.raises(urllib.error.HTTPError):
        chat.persistent(lambda: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "no", {}, None)), service, waits.append)
    assert plain.loose_json('so: {"a": [1]} end') == {"a": [1]}


def test_scan_gives_every_document_a_status(spark):
    import time

    readers = {".slow": lambda data: time.sleep(5), ".bad": lambda data: 1 / 0, ".html": html.parse, ".hwp": html.parse}
    docs = spark.createDataFrame([(1, ".slow", b""), (2, ".bad", b""), (3, ".html", b"<p>x"), (4, ".hwp", b"no")], "doc_id long, suffix string, content binary")
    assert {r.doc_id: r.status for r in scan.scan(docs, readers, 0.3).collect()} == {1: "timeout", 2: "parse_error", 3: "ok", 4: "skipped"}


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<h1>s</h1><p>one</p><p>two</p>")
    run = lambda: files.index_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    run()
    (tmp_path / "in" / "b.htm").write_text("<p>three</p>")
    run()
    assert sorted(r.source_text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["section: s\none", "section: s\ntwo", "three"]


def test_chunks_of_many_documents(spark):
    docs = spark.createDataFrame([(i, ".html", f"<p>one {i}</p><p>two</p>".encode()) for i in range(40)], "doc_id long, suffix string, content binary")
    from docweave.sources.registry import default_readers

    units = evidence.units(evidence.read(docs, default_readers()))
    rows = chunking.chunks(units.repartition(5)).collect()
    assert sorted((r.doc_id, r.ord, r.id) for r in rows) == [(i, k, f"chunk-{k}") for i in range(40) for k in (1, 2)]
    assert evidence.units(evidence.read(docs.limit(0), default_readers())).count() == 0


def test_signed_sink():
    import hashlib
    import hmac
    from datetime import datetime, timezone

    from docweave.operators import assets

    sent = []
    put = assets.signed_sink("https://store.example", "b", "id", "secret", prefix="/x/", region="eu", send=lambda r: sent.append(r) or 200, now=lambda: datetime(2020, 1, 31, 23, 59, 59, tzinfo=timezone.utc))
    assert put("a b/c.png", b"data", "image/png") == "s3://b/x/a b/c.png"
    (request,) = sent
    digest = hashlib.sha256(b"data").hexdigest()
    canonical = f"PUT\n/b/x/a%20b/c.png\n\ncontent-type:image/png\nhost:store.example\nx-amz-content-sha256:{digest}\nx-amz-date:20200131T235959Z\n\ncontent-type;host;x-amz-content-sha256;x-amz-date\n{digest}"
    key = b"AWS4secret"
    for part in ("20200131", "eu", "s3", "aws4_request", "AWS4-HMAC-SHA256\n20200131T235959Z\n20200131/eu/s3/aws4_request\n" + hashlib.sha256(canonical.encode()).hexdigest()):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    assert request.full_url == "https://store.example/b/x/a%20b/c.png" and request.get_method() == "PUT" and request.data == b"data"
    assert request.get_header("Authorization").endswith(f"Signature={key.hex()}")
    failing = assets.signed_sink("https://store.example", "b", "id", "secret", send=lambda r: 500)
    with pytest.raises(OSError, match="status 500"):
        failing("k", b"", "image/png")


def test_signature_of_the_published_example():
    """The example of the documentation of signature version 4 for GET Object."""
    from docweave.operators.assets import signature

    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    request = f"GET\n/test.txt\n\nhost:examplebucket.s3.amazonaws.com\nrange:bytes=0-9\nx-amz-content-sha256:{empty}\nx-amz-date:20130524T000000Z\n\nhost;range;x-amz-content-sha256;x-amz-date\n{empty}"
    scope, signed = signature("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "us-east-1", "20130524T000000Z", request)
    assert scope == "20130524/us-east-1/s3/aws4_request"
    assert signed == "f0e8bdb87c964420e857bd35b5d6ed310bd44f0170aba48dd91039c6036bdb41"


def test_documents_without_units_are_summed_up(spark):
    from docweave.operators import profiles
    from docweave.sources import evidence
    from docweave.sources.registry import default_readers

    docs = spark.createDataFrame([(1, ".html", "<p>some text</p>"), (2, ".html", ""), (3, ".pdf", "%PDF-1.7"), (4, ".pdf", None)], "doc_id long, suffix string, content string")
    found = evidence.read(docs, default_readers())
    flags = profiles.review_flags(profiles.document_summaries(evidence.units(found), evidence.assets(found), evidence.warnings(found), docs))
    assert {r.doc_id: r.flags for r in flags.collect()} == {1: "", 2: "no_units", 3: "no_units", 4: "no_units"}
    assert [(r.doc_id, r.type) for r in evidence.warnings(found).collect()] == [(3, "pdf_page_source_missing")]


def test_rows_of_one_id_keep_their_lines(spark):
    from docweave.sources import markdown

    docs = spark.createDataFrame([(1, "a1\na2\n# h\nb"), (1, "c1\n\nc2\n|x|y|\n|-|-|\n|1|2|"), (2, None), (None, "z")], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.ord, r.type, r.section, r.content) for r in markdown.scan(docs).collect())
    assert found == sorted([(1, 1, "text", "", "a1\na2"), (1, 2, "text", "h", "b"), (1, 1, "text", "", "c1"), (1, 2, "text", "", "c2"), (1, 3, "table", "", "|x|y|\n|-|-|\n|1|2|"), (0, 1, "text", "", "z")])


def test_pages_read_from_their_pictures(spark):
    import base64

    from docweave.sources import layout

    pages = [{"width": 10, "height": 10, "images": [{"x0": 0, "top": 0, "x1": 10, "bottom": 10}], "picture": base64.b64encode(b"png").decode()}]
    found = layout.parse_with(lambda data: pages, lambda picture, n: f"{picture.decode()} of page {n}")(b"%PDF")
    assert [u["content"] for u in found.units] == ["png of page 0"]
