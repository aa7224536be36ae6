"""Readers on documents made by hand."""

import io
import json
import struct
import zipfile
import zlib

import pytest

from docweave.sources import compound, evidence, html, hwp5, hwpx, layout
from docweave.sources.registry import default_readers


def said(parsed):
    return [(u["type"], u["source"]["text"]) for u in parsed.units]


def test_html_tree_is_lenient():
    assert said(html.parse(b"<body><p>one<p>two</body>")) == [("text", "onetwo")]
    assert said(html.parse(b"<p>a</p></div></p><p>b</p>")) == [("text", "a"), ("text", "b")]
    assert said(html.parse("<p>ä&amp;&#65;<!-- no --><script>x()</script> b<br>c</p>".encode())) == [("text", "ä&A b c")]
    assert html.parse(b"").units == [] and html.parse(b"\xff<p>x").units[-1]["content"] == "x"


def test_html_sections_links_lists_and_furniture():
    parsed = html.parse(b"<header>no</header><main><h1>A</h1><p>x <a href='/u'>y</a> <a href='/v'></a></p><h2>B</h2><ul><li>q</li><li>r</li></ul><h1>C</h1><pre>  k\n  l </pre><div class='fileBox'>no</div><nav>no</nav></main>")
    assert said(parsed) == [("text", "section: A\nx y (/u) /v"), ("text", "section: A > B\nq"), ("text", "section: A > B\nr"), ("text", "section: C\nk\n  l")]
    assert [u["id"] for u in parsed.units] == ["b1", "b2", "b3", "b4"]
    assert said(html.parse(b"<div class=viewCont><div class=title>T</div><p>x</p></div><p>no</p>")) == [("text", "T"), ("text", "section: T\nx")]


def test_html_table_spans_children_and_headers():
    parsed = html.parse(b"<table><caption>cap</caption><tr><td>lead</td></tr><tr><th>a</th><th></th><th>c</th></tr><tr><td rowspan=2>1</td><td colspan=x>2</td><td>3</td><td>over</td></tr><tr><td>4<table><tr><td>n</td></tr><tr><td>m</td></tr></table></td></tr></table>")
    table = parsed.units[0]["content"]
    assert [c["text"] for c in table["columns"]] == ["a", "Column 2", "c"]
    assert [[(c["column_id"], c["text"], c["rowspan"]) for c in r["cells"]] for r in table["rows"]] == [[("c1", "lead", 1)], [("c1", "1", 2), ("c2", "2", 1), ("c3", "3", 1)], [("c2", "4", 1)]]
    assert table["rows"][2]["cells"][0]["children"][0]["content"]["rows"][0]["cells"][0]["text"] == "m"
    assert parsed.units[0]["source"]["text"].splitlines()[-1] == "row 3: Column 2=4; nested table: columns: n / rows: 1"
    assert parsed.units[0]["metadata"]["table"] == {"table_id": "t1", "headers": ["a", "Column 2", "c"], "row_count": 3}


def test_html_images():
    parsed = html.parse(b"<figure><img src='data:image/PNG;base64,aGk=' alt=x><figcaption>cap</figcaption></figure><img src='http://x'><img src='data:image/svg+xml;base64,aGk='><img src='data:image/png;base64,a'><img>")
    assert [(a["id"], a["data"], a["ext"]) for a in parsed.assets] == [("img-0001", b"hi", "png")]
    assert parsed.units[0]["content"] == {"asset_id": "img-0001", "caption": "cap"}
    assert [w["type"] for w in parsed.warnings] == ["html_image_external_reference", "html_image_mime_unsupported", "html_image_data_uri_invalid", "html_image_external_reference"]


def archive(body, more=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Contents/section0.xml", f'<s xmlns="http://www.hancom.co.kr/hwpml/2011/paragraph">{body}</s>')
        for name, data in (more or {}).items():
            z.writestr(name, data)
    return out.getvalue()


def cell(text, **attrs):
    return f"<tc {' '.join(f'{k}=\"{v}\"' for k, v in attrs.items())}><subList><p><run><t>{text}</t></run></p></subList></tc>"


def test_hwpx_headers_pictures_and_drawings():
    table = f"<p><run><tbl><tr>{cell('G', colSpan=2)}</tr><tr>{cell('a', rowAddr=1)}{cell('b', rowAddr=1)}</tr><tr>{cell('1', rowAddr=2)}{cell('2', rowAddr=2)}</tr></tbl></run></p>"
    picture = '<p><run><pic><img binaryItemIDRef="i1"/></pic></run></p><p><run><pic><img binaryItemIDRef="i2"/></pic></run></p>'
    drawn = '<p><run><rect x="0" y="0" width="9" height="9"><t>A</t></rect><rect x="90" y="0" width="9" height="9"><t>B</t></rect><line x="9" y="4" width="80" height="0" headArrow="1"/><ole/></run></p><p><run><rect x="0" y="0" width="9" height="9"><t>alone</t></rect></run></p>'
    lone = f"<p><run><tbl><tr>{cell('boxed')}</tr></tbl></run></p>"
    data = archive(table + picture + drawn + lone, {"Contents/content.hpf": '<p xmlns="http://www.idpf.org/2007/opf/"><item id="i1" href="BinData/x.png"/></p>', "BinData/x.png": b"\x89PNG\r\n\x1a\nrest"})
    parsed = hwpx.parse(data)
    assert said(parsed) == [("table", "table: 2 columns\nheader 1: cols 1-2: G\nheader 2: col 1: a; col 2: b\nrow 1: G / a: 1; G / b: 2"), ("image", "image: img-0001"), ("diagram", "A\nB\nrelations:\nn1 -> n2"), ("text", "alone"), ("text", "boxed")]
    assert sorted(w["type"] for w in parsed.warnings) == ["hwpx_drawing_structure_unsupported", "hwpx_image_reference_unresolved"]
    assert parsed.assets[0]["mime"] == "image/png"


def test_hwpx_flow_chart_table_and_ocr():
    rows = [["head", "x"], ["처리절차", ""], ["신청", "→ (접수)"], ["", "검토"]]
    body = "".join(f"<tr>{''.join(cell(t, rowAddr=i, colAddr=j) for j, t in enumerate(r))}</tr>" for i, r in enumerate(rows))
    kinds = [u["type"] for u in hwpx.parse(archive(f"<p><run><tbl>{body}</tbl></run></p>")).units]
    assert kinds == ["diagram"]
    picture = archive('<p><run><pic><img binaryItemIDRef="i1"/></pic></run></p>', {"Contents/content.hpf": '<p><item id="i1" href="BinData/x.png"/></p>', "BinData/x.png": b"GIF8"})
    assert said(hwpx.parse(picture, ocr=lambda data, n: " read  it ")) == [("image", "image: img-0001"), ("text", "read it")]
    assert hwpx.parse(picture, ocr=lambda data, n: 1 / 0).warnings[0]["type"] == "hwpx_ocr_failed"


def utf16(text):
    return text.encode("utf-16-le")


def shape(kind, x, y, w, h, number):
    return hwp5.packed(hwp5.CONTROL, 1, b" osg" + b"\0" * 4 + struct.pack("<4I", x, y, w, h) + b"\0" * 8 + struct.pack("<I", number)) + hwp5.packed(hwp5.SHAPE, 2, kind)


def test_hwp5_tables_pictures_and_diagrams():
    parts = [hwp5.packed(hwp5.PARA_TEXT, 1, utf16("first\x02" + "......." + "more"))]
    parts += [hwp5.packed(hwp5.CONTROL, 1, b" lbt"), hwp5.packed(hwp5.TABLE, 2, b"\0" * 4 + struct.pack("<HH", 2, 2))]
    for r, c, tall, text in ((0, 0, 1, "h1"), (0, 1, 1, "h2"), (1, 0, 1, "x"), (1, 1, 1, "y"), (5, 5, 1, "outside")):
        parts += [hwp5.packed(hwp5.LIST, 2, b"\0" * 8 + struct.pack("<HHHH", c, r, 1, tall)), hwp5.packed(hwp5.PARA_TEXT, 3, utf16(text)) if text != "outside" else b""]
    parts += [shape(b"cip$", 0, 0, 9, 9, 1), hwp5.packed(hwp5.PICTURE, 2, b"\0" * 71 + struct.pack("<H", 1))]
    parts += [shape(b"cer$", 0, 0, 100, 100, 7), hwp5.packed(hwp5.PARA_TEXT, 3, utf16("A")), shape(b"cer$", 500, 0, 100, 100, 8), hwp5.packed(hwp5.PARA_TEXT, 3, utf16("B"))]
    parts += [shape(b"nil$", 100, 50, 400, 1, 9), hwp5.packed(hwp5.LINE, 2, struct.pack("<4iI4I", 0, 0, 1, 1, 1, 8, 0, 7, 0)), shape(b"nil$", 0, 0, 10, 10, 9), hwp5.packed(hwp5.LINE, 2, struct.pack("<4iI4I", 0, 0, 1, 1, 0, 99, 0, 7, 0))]
    parts += [hwp5.packed(hwp5.PARA_TEXT, 1, utf16("long " * 2000))]
    press = zlib.compressobj(9, zlib.DEFLATED, -15)
    info = hwp5.packed(hwp5.BIN_DATA, 0, struct.pack("<HHH", 1, 3, 3) + utf16("png"))
    squeeze = lambda b: (p := zlib.compressobj(9, zlib.DEFLATED, -15)).compress(b) + p.flush()
    streams = {"FileHeader": b"x".ljust(36, b"\0") + struct.pack("<I", 1), "DocInfo": squeeze(info), "BodyText/Section0": press.compress(b"".join(parts)) + press.flush(), "BinData/BIN0003.png": b"\x89PNG\r\n\x1a\nraw"}
    data = compound.build(streams)
    assert compound.CompoundFile(data).streams["BinData/BIN0003.png"].startswith(streams["BinData/BIN0003.png"])
    parsed = hwp5.parse(data)
    kinds = [u["type"] for u in parsed.units]
    assert kinds == ["text", "table", "image", "diagram", "text"] and parsed.units[0]["content"] == "firstmore"
    assert parsed.units[1]["source"]["text"] == "table: 2 columns\nheader 1: col 1: h1; col 2: h2\nrow 1: h1: x; h2: y"
    assert parsed.units[3]["content"]["edges"][0] | {"label": ""} == {"from": "n2", "to": "n1", "type": "arrow", "label": "", "confidence": "parsed_subject_ids", "connector_id": "c1"}
    assert {w["type"] for w in parsed.warnings} == {"hwp5_drawing_structure_partial", "hwp5_diagram_connector_unresolved"}
    assert next(w for w in parsed.warnings if "connectors" in w)["connectors"][0]["resolution_failure"] == "subject_id_unmatched"
    assert hwp5.parse(data, ocr=lambda d, n: "first more").units[-1]["type"] == "text" and len(hwp5.parse(data, ocr=lambda d, n: "first more").units) == 5
    assert len(hwp5.parse(data, ocr=lambda d, n: "something else").units) == 6
    assert hwp5.parse_or_skip(b"no")[0].warnings[0]["type"] == "non_hwp5_skipped"


def test_records_of_any_size():
    made = hwp5.packed(1, 2, b"a") + hwp5.packed(3, 4, b"b" * 5000)
    assert [(t, v, len(p)) for t, v, p in hwp5.records(made + b"\0")] == [(1, 2, 1), (3, 4, 5000)]


def chars(text, x, y):
    return [{"text": c, "x0": x + 6 * i, "x1": x + 6 * i + 5, "top": y, "bottom": y + 10} for i, c in enumerate(text)]


def page_table(y, rows, xs=(50, 150, 250)):
    return {"bbox": [xs[0], y, xs[-1], y + 20 * len(rows)], "rows": [{"cells": [[xs[j], y + 20 * i, xs[j + 1], y + 20 * i + 20] for j in range(len(r))], "texts": r} for i, r in enumerate(rows)]}


def test_layout_continues_tables_and_fills_gaps():
    one = {"width": 600, "height": 800, "chars": chars("Intro text of the page", 50, 40), "tables": [page_table(100, [["h1", "h2"], ["a", "b"], ["", "c"]])]}
    two = {"width": 600, "height": 800, "chars": chars("end", 50, 700) + chars("12", 300, 780), "tables": [page_table(20, [["h1", "h2"], ["x", "y"]])]}
    parsed = layout.parse_pages([one, two])
    assert said(parsed) == [("text", "Intro text of the page"), ("table", "table: 2 columns\nheader 1: col 1: h1; col 2: h2\nrow 1: h1: a; h2: b\nc\nrow 2: h1: x; h2: y"), ("text", "end")]


def test_layout_scanned_pages_and_diagrams():
    scan = {"width": 100, "height": 100, "chars": [], "images": [{"x0": 0, "x1": 90, "top": 0, "bottom": 90}]}
    assert layout.parse_pages([scan]).units == []
    read = layout.parse_pages([scan], ocr=lambda data, n: "para\n\n| a | b |\n|---|---|\n| 1 | 2 |")
    assert [u["type"] for u in read.units] == ["text", "table"] and read.warnings[0]["type"] == "pdf_ocr_table_inferred"
    assert layout.parse_pages([scan], ocr=lambda data, n: 1 / 0).warnings[0]["type"] == "pdf_ocr_failed"
    drawn = {"width": 600, "height": 800, "chars": chars("A", 60, 300) + chars("B", 260, 300), "rects": [{"x0": 50, "x1": 120, "top": 290, "bottom": 320}, {"x0": 250, "x1": 320, "top": 290, "bottom": 320}], "lines": [{"x0": 120, "x1": 250, "top": 305, "bottom": 305}]}
    assert said(layout.parse_pages([drawn])) == [("diagram", "A\nB\nrelations:\nn1 -> n2")]
    assert layout.skips({"nodes": [{"text": t, "bbox": {"width": 9, "height": 9}} for t in ("연번", "질의", "답변")], "connectors": [1]})


def test_layout_nested_table_and_cell_image():
    inner = page_table(125, [["n1", "n2"], ["v", "w"]], (160, 190, 220))
    outer = {"bbox": [50, 100, 250, 200], "rows": [{"cells": [[50, 100, 150, 120], [150, 100, 250, 120]], "texts": ["h1", "h2"]}, {"cells": [[50, 120, 150, 200], [150, 120, 250, 200]], "texts": ["a", "n1 n2 v w"]}]}
    image = {"x0": 52, "x1": 148, "top": 125, "bottom": 195, "data": "iVBORw0KGgo="}
    parsed = layout.parse_pages([{"width": 600, "height": 800, "chars": chars("a", 55, 122) + chars("n1", 162, 127) + chars("this page has text of its own, enough", 50, 400), "tables": [outer, inner], "images": [image]}])
    row = parsed.units[0]["content"]["rows"][0]["cells"]
    assert [c["children"][0]["type"] for c in row] == ["image", "table"] and row[1]["text"] == ""


def test_reading_a_table_of_documents(spark):
    docs = spark.createDataFrame([(1, ".HTML", b"<h1>s</h1><p>x</p>"), (2, "htm", None), (3, "pages.json", json.dumps({"pages": []}).encode())], "doc_id long, suffix string, content binary")
    found = evidence.read(docs, default_readers())
    assert [(r.doc_id, r.content, r.section_path) for r in evidence.units(found).collect()] == [(1, "x", ["s"])]
    bad = spark.createDataFrame([(1, ".exe", b"")], "doc_id long, suffix string, content binary")
    with pytest.raises(Exception, match="no reader for '.exe'"):
        evidence.read(bad, default_readers()).count()
    assert evidence.read(docs.limit(0), default_readers()).count() == 0
