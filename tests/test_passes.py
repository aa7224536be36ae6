"""What is read fast, in few shuffles and little memory is what is read slowly."""

import json
import random

import pyarrow as pa
import pytest

from docweave.functions import plain, text as columns
from docweave.operators import chunking, diagrams, enrichment, passes, rendering
from docweave.plans import synthetic
from docweave.sources import evidence, html
from docweave.sources.registry import default_readers
from docweave.sources.spread import by_document

SF = "/root/testdata/sf0.001"
PARTS = ["<p>", "</p>", "<TD>", "</td>", "<tr>", "</tr>", "<table>", "</table>", "a ", "&amp;", "&lt", "b\n", "<br>", "<br/>", '<a href="/x y">', "</a>", '<div class="viewCont">', "</div>", "<!-- c -->", "<", "<1", "<main>", "<h1>t</h1>", "<li>", "<nav>", '<td rowspan="2">', "<td colspan=2>", "<title>x</title>", "</nope>", "<tr><td>a</td><td>b c</td></tr>", "<tr><th>h%</th><th>k</th></tr>", '<tr><td>1</td><td>"q\\ %d</td></tr>', "<tr><td></td><td>\n x\n</td></tr>", "<tr><td>z</td></tr>", "<caption> c </caption>"]


def page(key, n):
    rows = "".join(f"<tr><td>{i}</td><td>part {key}</td></tr>" for i in range(n))
    return f"<html><body><main><h1>Order {key}</h1><table><caption>Lines</caption><tr><th>line</th><th>part</th></tr>{rows}</table></main></body></html>"


def test_plain_markup_reads_as_the_tokeniser_reads_it(monkeypatch):
    r = random.Random(7)
    texts = ["".join(r.choices(PARTS, k=r.randint(0, 12))) for _ in range(3_000)] + ["<table>" + "".join(r.choices(PARTS[-7:], k=r.randint(1, 5))) + "</table>" for _ in range(1_000)]
    fast = [evidence.rows_of(1, html.parse(x.encode())) for x in texts]
    assert sum(html.plain_tree(x) is not None for x in texts) > 1_000
    monkeypatch.setattr(html, "plain_tree", lambda text: None)
    assert fast == [evidence.rows_of(1, html.parse(x.encode())) for x in texts]


def test_a_table_of_plain_cells_makes_no_tree(monkeypatch):
    monkeypatch.setattr(html.PlainTable, "children", property(lambda self: pytest.fail("its cells became elements")))
    (unit,) = html.parse(page(1, 3).encode()).units
    assert json.loads(unit["content"].text) == unit["content"] and len(unit["content"]["rows"]) == 3


def test_pages_are_shuffled_once_and_nothing_runs_before(spark):
    plan = synthetic.order_pages(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan
    ids = lambda: set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    df, before = spark.range(10).selectExpr("id AS doc_id").repartition(3).groupBy("doc_id").count(), ids()
    made = by_document(df)
    assert ids() == before
    assert made.count() == 10


def test_one_pass_makes_what_the_plans_make(spark):
    docs = spark.createDataFrame([(k, ".html", page(k, k % 4) + "<p>after it.") for k in range(1, 30)], "doc_id long, suffix string, content string")
    readers = default_readers()
    units = evidence.units(evidence.read(docs, readers))
    rows = lambda df: sorted(map(tuple, df.collect()))
    chunks = enrichment.enrich(chunking.chunks(units, together=True))
    assert rows(passes.chunks(docs, readers, fill=enrichment.filled)) == rows(chunks)
    assert rows(passes.chunks(docs, readers, fill=enrichment.filled, columns=("doc_id", "summary"))) == rows(chunks.select("doc_id", "summary"))
    assert rows(passes.chunk_pages(docs, readers, enrich=enrichment.enriched)) == rows(rendering.chunk_pages(chunks, together=True))
    assert rows(passes.unit_pages(docs, readers)) == rows(rendering.unit_pages(units, together=True))
    assert rows(passes.evidence_json(docs, readers)) == rows(rendering.evidence_json(units, together=True))


def test_few_rows_become_objects_at_a_time():
    batch = pa.RecordBatch.from_pylist([{"doc_id": k, "suffix": ".x", "content": "c"} for k in range(5_000)])
    alive, most = set(), 0

    class Seen(list):
        def __del__(self):
            alive.discard(id(self))

    def reader(data):
        found = evidence.Parsed()
        found.units = Seen()
        alive.add(id(found.units))
        found.add("text", "plain", "x", "x", [])
        return found

    for _ in evidence.parsed({".x": reader})(iter([batch])):
        most = max(most, len(alive))
    assert most <= 2
    assert max(x.num_rows for x in evidence.sliced(iter([batch]))) <= evidence.SLICE
    made = list(evidence.in_batches(({"a": "x" * 1_000_000} for _ in range(20)), pa.schema([("a", pa.string())])))
    assert sum(x.num_rows for x in made) == 20 and max(x.num_rows for x in made) <= 5


def test_rows_are_counted_once_where_a_table_is_cut(monkeypatch):
    unit = html.parse(page(1, 200).encode()).units[0]
    item, seen = chunking.item_of(unit), []
    monkeypatch.setattr(plain, "tokens", lambda text, of=plain.tokens: seen.append(len(text)) or of(text))
    pieces = chunking.table_pieces(item, [], {"b1": unit}, chunking.Limits(target_tokens=400, most_tokens=400))
    assert 1 < len(pieces) < 20 and sum(len(x["content"]["rows"]) for x, _ in pieces) == 200
    assert all(plain.tokens(text) <= 400 for _, text in pieces)
    assert sum(seen) < 60_000


def test_boxes_meet_connectors_in_blocks(spark):
    r = random.Random(3)
    boxes = [(k % 2, f"n{k}", k, r.randrange(40), r.randrange(40), r.randrange(3), 2) for k in range(1_200)]
    ends = [(k % 2, k, *(r.randrange(60) for _ in range(4))) for k in range(50)]
    edges = diagrams.inferred_edges(spark.createDataFrame(boxes, "diagram long, node string, ord long, x long, y long, w long, h long"), spark.createDataFrame(ends, "diagram long, connector long, x1 long, y1 long, x2 long, y2 long"))
    of = [[(n, (x, y, w, h)) for at, n, _, x, y, w, h in boxes if at == d and w > 0] for d in (0, 1)]
    expected = [(d, c, diagrams.nearest({"x": x1, "y": y1}, of[d]), diagrams.nearest({"x": x2, "y": y2}, of[d])) for d, c, x1, y1, x2, y2 in ends]
    assert sorted(map(tuple, edges.collect())) == [e for e in sorted(expected) if e[2] != e[3]]
    assert "min_by(" not in edges._jdf.queryExecution().executedPlan().toString()  # which sorts every pair


def test_documents_are_read_where_they_are_made():
    alive, most = 0, []

    class Content(bytes):
        def __new__(cls, *args):
            nonlocal alive
            alive += 1
            return super().__new__(cls, *args)

        def __del__(self):
            nonlocal alive
            alive -= 1

    def reader(data):
        most.append(alive)
        return evidence.Parsed()

    batch = pa.RecordBatch.from_pylist([{"doc_id": k} for k in range(3_000)])
    assert len(list(evidence.parsed({".x": reader}, (".x", lambda row: Content(b"c")))(iter([batch])))) == 3_000 == len(most)
    assert max(most) <= 2


def test_scalar_rules_look_no_further_than_they_need(spark):
    from pyspark.sql import functions as F

    texts = ["", "\n\x1c 　", "   \x85first  line \x0bsecond", "a\r\nb", "\x1fx\x1f y", "one  two\t three\n", "x" * 600 + "\n  ", " " * 600 + "y\n" * 300, "é   ü", "~!  ~"]
    df, c = spark.createDataFrame([(x,) for x in texts], "x string"), F.col("x")
    found = df.select(columns.strip(c), columns.normalize_space(c), columns.first_line(c, 100), columns.topic(c), columns.flat_summary(c), columns.clipped(c, 90)).collect()
    assert [tuple(r) for r in found] == [(x.strip(), plain.flat(x), plain.first_line(x), plain.topic(x), plain.flat_summary(x), plain.clipped(x, 90)) for x in texts]
    assert columns.SPACES == "".join(x for x in map(chr, range(0x110000)) if x.isspace())
    plan = df.select(columns.strip(c), columns.first_line(c, 100), columns.topic(c))._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan  # into all lines, for the first


def test_documents_of_parts_are_spread_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert cores > 1 == spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions()
    assert synthetic.image_pages(spark, SF).rdd.getNumPartitions() >= cores
    for made in (synthetic.nested_pages, synthetic.hwpx_regions, synthetic.layout_regions):
        plan = made(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, plan  # which is not merged
