"""The pipeline over decoded tables, the store, feeds, files and checks."""

import json

import pytest
from pyspark.sql import functions as F

from quire import schema as S
from quire.operators import artifacts as A
from quire.operators import linking, quality, views
from quire.plans import pipeline, synthetic
from quire.sources import feed, files, store
from tests.conftest import SF


@pytest.fixture(scope="module")
def made(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 12").cache()
    decoded = synthetic.Synthetic(docs)
    return decoded, pipeline.run_pipeline(decoded)


def test_ids_and_order_are_dense(made):
    _, r = made
    for table, key in ((r.regions, "region"), (r.chunks, "chunk")):
        for row in table.groupBy("paper_id").agg(F.count("*").alias("n"), F.max("order_index").alias("m")).collect():
            assert row.n == row.m + 1
        assert table.filter(~F.col(f"{key}_id").contains(f"::{key}::")).count() == 0
    assert r.regions.filter(~F.col("section").isin(*S.SECTIONS)).count() == 0


def test_without_layout_papers_keep_baseline_chunks(made):
    decoded, _ = made
    r = pipeline.run_pipeline(decoded, detect_layout=False)
    assert r.regions.count() == 0 and r.chunks.filter("section <> 'unknown'").count() == 0 and r.chunks.count() > 0
    with pytest.raises(ValueError):
        pipeline.run_pipeline(decoded, dpi=0)


def test_records_survive_and_corrupt_ones_are_marked(spark, made, tmp_path):
    _, r = made
    records = store.to_records(store.results(r.papers, r.pages, r.regions, r.chunks, r.artifacts)).cache()
    path = str(tmp_path / "store")
    store.save(records, path)
    store.save(spark.createDataFrame([("doc-1", '{"broken'), ("zz", ""), ("é", records.first().record)], "paper_id string, record string"), path)
    got = {x.paper_id: x for x in store.load(spark, path).collect()}
    assert len(got) == records.count() + 2
    assert got["doc-1"].corrupt and got["zz"].corrupt and got["doc-1"].result is None
    whole = got["doc-2"].result
    assert json.loads(records.filter("paper_id = 'doc-2'").first().record)["chunks"][0]["text"] == whole.chunks[0].text
    assert [store.lookup(spark, path, i).first().status for i in ("doc-2", "doc-1", "no")] == [200, 500, 404]
    ids = [x.paper_id for x in store.paper_ids(spark, path).collect()]
    assert ids == sorted(ids) and len(ids) == len(got)
    store.compact(spark, path)
    again = {x.paper_id: x for x in store.load(spark, path).collect()}
    assert {k: (v.corrupt, v.result) for k, v in again.items()} == {k: (v.corrupt, v.result) for k, v in got.items()}
    store.save(records.filter("paper_id = 'doc-1'"), path)
    assert store.lookup(spark, path, "doc-1").first().status == 200 and store.load(spark, path).count() == len(got)


def test_a_save_touches_its_own_rows_only(spark, tmp_path):
    path = str(tmp_path / "store")
    store.save(spark.createDataFrame([(f"p{i}", "{}") for i in range(500)], "paper_id string, record string"), path)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    store.save(spark.createDataFrame([("p7", "new"), ("p7", "newer")], "paper_id string, record string").coalesce(1), path)
    after = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    assert before.items() <= after.items() and 1 <= len(after) - len(before) <= 2
    assert store.load(spark, path).count() == 500
    assert store._newest(store._stored(spark, path, store._RECORD)).filter("paper_id = 'p7'").first().record == "newer"


def test_sources_are_kept_and_comparison_needs_one(spark, made, tmp_path):
    decoded, r = made
    records, kept = str(tmp_path / "records"), str(tmp_path / "raw")
    assert store.source(spark, kept, "doc-2").count() == 0 and store.comparison_status(spark, records, kept, "doc-2").first().status == 404
    store.save(store.to_records(store.results(r.papers, r.pages, r.regions, r.chunks, r.artifacts)).filter("paper_id in ('doc-2', 'doc-3')"), records)
    store.save(spark.createDataFrame([("bad", "{")], "paper_id string, record string"), records)
    store.save_sources(spark.createDataFrame([("doc-2", b"%PDF old"), ("bad", b"x")], "paper_id string, content binary"), kept)
    store.save_sources(spark.createDataFrame([("doc-2", b"%PDF new")], "paper_id string, content binary"), kept)
    assert bytes(store.source(spark, kept, "doc-2").first().content) == b"%PDF new"
    assert {x.paper_id: bytes(x.content) for x in store.sources(spark, kept).collect()} == {"doc-2": b"%PDF new", "bad": b"x"}
    status = lambda i: store.comparison_status(spark, records, kept, i).first().status
    assert [status(i) for i in ("doc-2", "doc-3", "bad", "no")] == [200, 409, 500, 404]


def test_walkthrough_without_a_source(spark, made):
    decoded, r = made
    found = store.results(r.papers, r.pages, r.regions, r.chunks, r.artifacts)
    docs = decoded.docs.filter("paper_id <> 'doc-2'")
    got = {x.paper_id: json.loads(x.walkthrough) for x in pipeline.walkthrough(found, docs, decoded.flat).collect()}
    assert got["doc-2"]["baseline"] is None and got["doc-2"]["source_bytes"] is None
    assert got["doc-3"]["baseline"][0]["chunk_id"] == "doc-3::chunk::0"


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        """<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A wrapped
   title</title><link href="http://x/html" title="html"/><link href="http://x/pdf" title="pdf"/></entry>
<entry><id>http://arxiv.org/abs/9</id><title>No pdf</title><link href="http://x/html" title="html"/></entry></feed>"""
    )
    rows = feed.read_feed(spark, str(tmp_path / "f.xml")).collect()
    assert [tuple(r) for r in rows] == [("2401.00001v2", "A wrapped title", "http://x/pdf", "2401.00001v2_A_wrapped_title.pdf")]


def test_fetching_goes_on_after_failures(spark):
    def get(url):
        if url == "u3":
            raise OSError("gone")
        return b"%PDF " + url.encode() if url != "u2" else b"<html>"

    found = spark.createDataFrame([(f"p{i}", "t", f"u{i}", f"p{i}.pdf") for i in range(1, 6)], "paper string, title string, pdf_url string, filename string")
    have = spark.createDataFrame([("p5.pdf",)], "filename string")
    got = {r.paper: (r.content and bytes(r.content), r.error) for r in feed.fetch(found, have, get, delay=0.0).collect()}
    assert got == {"p1": (b"%PDF u1", None), "p2": (None, "not a PDF"), "p3": (None, "OSError: gone"), "p4": (b"%PDF u4", None)}


def test_files(spark, tmp_path):
    (tmp_path / "My paper.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "bad.PDF").write_bytes(b"html")
    (tmp_path / "notes.txt").write_bytes(b"%PDF")
    got = {r.source_filename: r for r in files.read_pdfs(spark, str(tmp_path)).collect()}
    assert set(got) == {"My paper.pdf", "bad.PDF"} and got["My paper.pdf"].readable and not got["bad.PDF"].readable
    import hashlib

    assert got["My paper.pdf"].paper_id == "My paper-" + hashlib.sha1(b"%PDF-1.4 x").hexdigest()[:12]


def test_a_broken_file_is_marked_and_others_are_decoded(spark):
    def decoder(content):
        if b"broken" in content:
            raise RuntimeError("no objects")
        if b"odd" in content:
            return {"pages": [{"page": "first"}]}
        span = {"page": 0, "block_no": 0, "line_no": 0, "span_no": 0, "bx0": 54.0, "by0": 90.0, "bx1": 300.0, "by1": 110.0, "text": "1. Introduction", "font": "Times-Bold", "size": 14.0}
        below = span | {"block_no": 1, "by0": 150.0, "by1": 160.0, "text": "Words of a paragraph that goes on. " * 5, "font": "Times-Roman", "size": 9.0}
        return {"meta_title": "A title", "pages": [{"page": 0, "width": 612.0, "height": 792.0}], "flat": [{"page": 0, "text": "1. Introduction\nWords"}], "spans": [span, below]}

    rows = [("a", "a.pdf", b"%PDF good"), ("b", "b.pdf", b"%PDF broken"), ("c", "c.pdf", b"<html>"), ("d", "d.pdf", b"%PDF odd"), ("e", "e.pdf", None)]
    decoded = files.DecodedFiles(spark.createDataFrame(rows, "paper_id string, source_filename string, content binary"), decoder)
    assert {r.paper_id: r.error.partition(":")[0] for r in decoded.failed.collect()} == {"b": "RuntimeError", "c": "ValueError", "d": "ArrowInvalid", "e": "ValueError"}
    r = pipeline.run_pipeline(decoded)
    assert [(x.paper_id, x.title, x.page_count) for x in r.papers.collect()] == [("a", "A title", 1)]
    assert [x.region_type for x in r.regions.orderBy("order_index").collect()] == ["heading", "body"]
    report = quality.paper_report(r.regions, decoded.failed.select("paper_id"))
    assert quality.corpus_totals(report).first().flagged_papers == 4
    assert files.DecodedFiles(spark.createDataFrame([], "paper_id string, source_filename string, content binary"), decoder).pages.count() == 0


def test_tiles_previews_badges_and_legend(spark, made):
    _, r = made
    tiles = views.artifact_tiles(r.artifacts).collect()
    assert tiles and all(t.place < 8 and (t.caption or t.caption == views.NO_CAPTION) for t in tiles)
    shown = views.link_previews(r.artifacts, r.chunks).collect()
    by = {}
    for p in shown:
        by.setdefault(p.paper_id, []).append(p.place)
        assert "_" not in p.section and (p.marked == "" or p.marked.lower()[:3] in ("fig", "tab", "equ", "eq."))
    assert by and all(sorted(v) == list(range(len(v))) and len(v) <= 4 for v in by.values())
    boxes = views.overlay(r.regions, r.pages).groupBy("paper_id", "page").agg(F.count("*").alias("n"), F.max("badge").alias("m"), F.min("badge").alias("l")).collect()
    assert boxes and all(b.n == b.m and b.l == 1 for b in boxes)
    legend = views.overlay_legend(r.regions)
    assert legend.agg(F.sum("regions")).first()[0] == r.regions.count()
    assert views.overlay_lookup(r.regions, r.pages, "doc-2", 0).first().status == 200
    assert views.overlay_lookup(r.regions.filter("paper_id <> 'doc-2'"), r.pages, "doc-2", 0).first().status == 404


def test_upload_types(spark):
    rows = [("a.pdf", "text/plain", True), ("a.txt", "application/pdf", True), ("a", "application/x-pdf", True), ("a.txt", "text/plain", False), ("a.PDF", None, True), ("b", None, False)]
    df = spark.createDataFrame(rows, "n string, t string, want boolean")
    assert all(r.got == r.want for r in df.select("want", files.is_pdf(F.col("n"), F.col("t")).alias("got")).collect())


REGION = "region_id string, paper_id string, region_type string, bbox struct<page:int,x0:double,y0:double,x1:double,y1:double>, text string, order_index int"


def _regions(spark, *rows):
    return spark.createDataFrame([(f"p::region::{i}", "p", k, (0, *map(float, b)), t, i) for i, (k, b, t) in enumerate(rows)], REGION)


def test_captions_pair_nearest_first_and_once(spark):
    r = _regions(
        spark, ("figure", (50, 100, 250, 200), ""), ("figure", (50, 230, 250, 330), ""), ("caption", (50, 205, 250, 215), "Figure 1: up"),
        ("caption", (50, 335, 250, 345), "Figure 2: down"), ("caption", (400, 205, 550, 215), "Figure 3: other column"),
    )
    assert {tuple(x)[1:] for x in A.pair_captions(r).collect()} == {("p::region::0", "Figure 1: up"), ("p::region::1", "Figure 2: down")}


def test_crops_stop_half_way(spark):
    r = _regions(spark, ("figure", (100, 100, 200, 200), ""), ("body", (202, 120, 300, 180), "beside"), ("body", (100, 204, 200, 220), "below"))
    images = spark.createDataFrame([("p", 0, "x", 1700, 2200, 200)], S.PAGES)
    c = A.crop_boxes(A.targets(r), r, images).first()
    assert (c.x0, c.y0, c.x1, c.y1) == (94.0, 94.0, 201.0, 202.0)
    assert (c.px0, c.py0, c.px1, c.py1) == (261, 261, 558, 561)
    assert A.targets(_regions(spark, ("figure", (0, 0, 23, 99), ""))).count() == 0


def test_links_by_label(spark):
    arts = spark.createDataFrame(
        [(f"p::artifact::{i}", "p", c, []) for i, c in enumerate(["Figure 1: a", "Table 1: b", "Figure 10: c", "no label", "Fig. 1 again"])],
        "artifact_id string, paper_id string, caption string, linked_chunk_ids array<string>",
    )
    chunks = spark.createDataFrame(
        [(f"p::chunk::{i}", "p", t, []) for i, t in enumerate(["see Figures 1 and 10", "Table 1", "nothing", "figure 1, figure 1"])],
        "chunk_id string, paper_id string, text string, artifact_ids array<string>",
    )
    a, c = linking.link(arts, chunks)
    number = lambda ids: [int(i.rsplit("::", 1)[1]) for i in ids]
    assert {number([x.artifact_id])[0]: number(x.linked_chunk_ids) for x in a.collect()} == {0: [0, 3], 1: [1], 2: [0], 3: [], 4: [0, 3]}
    assert {number([x.chunk_id])[0]: number(x.artifact_ids) for x in c.collect()} == {0: [0, 2, 4], 1: [1], 2: [], 3: [0, 4]}


def test_page_checks(spark):
    stray = [("body", (110 + 20 * i, 205, 120 + 20 * i, 212), "12") for i in range(5)]
    cases = {
        "clean": [("figure", (100, 100, 300, 200), ""), ("body", (50, 400, 550, 420), "some prose that is long enough to stand")],
        "no-text-layer": [("figure", (0, 0, 600, 700), "")],
        "5 tiny BODY regions around an artifact": [("figure", (100, 100, 300, 200), ""), *stray],
        "a TABLE and a FIGURE overlap": [("figure", (100, 100, 300, 200), "x"), ("table", (110, 110, 290, 190), "x")],
        "a BODY region covers the page": [("body", (0, 0, 600, 700), "x" * 30)],
        "a caption with nothing to caption": [("caption", (0, 0, 10, 10), "Figure 1: x"), ("body", (500, 700, 600, 710), "far away from it all")],
    }
    for message, rows in cases.items():
        got = quality.page_problems(_regions(spark, *rows)).first().problems
        assert got == ([] if message == "clean" else [message])
    report = quality.paper_report(_regions(spark, *cases["clean"]), spark.createDataFrame([("lost",)], "paper_id string"))
    assert quality.corpus_totals(report).first().flagged_papers == 1


def test_cards_list_damaged_records(spark):
    papers = spark.createDataFrame([("a", "A")], "paper_id string, title string")
    none = spark.createDataFrame([], "paper_id string")
    cards = views.paper_cards(papers, none, none, none, spark.createDataFrame([("b",)], "paper_id string")).collect()
    assert {(c.paper_id, c.damaged) for c in cards} == {("a", False), ("b", True)}
    links = views.gallery(spark.createDataFrame([("Linked Lists", 0, "x", 1, 1, 200)], S.PAGES)).first()
    assert links.href == "/paper/Linked%20Lists/page/0"


def test_lookups(made):
    _, r = made
    assert views.page_lookup(r.pages, "doc-2", 0).first().status == 200
    assert views.page_lookup(r.pages, "doc-2", 999).first().status == 404
    first = r.artifacts.filter("image_path is not null").orderBy("artifact_id").first()
    place = int(first.artifact_id.rsplit("::", 1)[1])
    assert views.artifact_lookup(r.artifacts, first.paper_id, place).first().image_path == first.image_path
    assert views.artifact_lookup(r.artifacts, first.paper_id, 999).first().status == 404


def test_kwic_marks_the_first_mention(spark):
    artifacts = spark.createDataFrame(
        [("p", "a0", "Figure 2: A plot.", ["c0", "c1"]), ("p", "a1", "A plot.", ["c1"]), ("p", "a2", "Table 1: Rows.", [])],
        "paper_id string, artifact_id string, caption string, linked_chunk_ids array<string>",
    )
    texts = [("p", "c0", "x" * 70 + " see\nFigure 2 and Figure 2 again " + "y" * 80), ("p", "c1", "z" * 160)]
    chunks = spark.createDataFrame(texts, "paper_id string, chunk_id string, text string")
    got = {r.artifact_id: (r.chunk_id, r.before, r.marked, r.after) for r in views.keyword_in_context(artifacts, chunks).collect()}
    flat = texts[0][2].replace("\n", " ")
    at = flat.index("Figure 2")
    assert got == {
        "a0": ("c0", "… " + flat[at - 62 : at], "Figure 2", flat[at + 8 : at + 82] + " …"),
        "a1": ("c1", "z" * 150 + " …", "", ""),
    }


def test_a_scope_owns_the_tables_written_inside(spark):
    from pathlib import Path

    from quire.sources import shared

    base = Path(shared.shared_dir(spark))
    before = set(base.iterdir())
    with shared.scope(spark):
        table = shared.written(spark.range(5), "kept")
        assert table.count() == 5 and set(base.iterdir()) - before
    assert set(base.iterdir()) == before
