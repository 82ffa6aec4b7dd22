"""Kernels on documented shapes, and relational steps against kernels and literal folds."""

import random

from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.operators import chunking, layout, sections
from quire.operators import columns as O
from quire.operators import kernels as K


def test_clusters_do_not_depend_on_order():
    r = random.Random(1)
    for _ in range(300):
        boxes = [(x, y, x + r.randint(0, 40), y + r.randint(0, 40)) for x, y in ((r.randint(0, 300), r.randint(0, 300)) for _ in range(12))]
        one = {b for b, _ in K.clusters(boxes, 12.0)}
        r.shuffle(boxes)
        assert one == {b for b, _ in K.clusters(boxes, 12.0)}


def literal_clusters(boxes, reach):
    groups = [(b, [i]) for i, b in enumerate(boxes)]
    while True:
        out = []
        for b, members in groups:
            k = next((k for k, (host, _) in enumerate(out) if K.near(b, host, reach)), None)
            if k is None:
                out.append((b, members))
            else:
                out[k] = (K.union(out[k][0], b), out[k][1] + members)
        if len(out) == len(groups):
            return out
        groups = out


def test_clusters_equal_literal_passes():
    r = random.Random(3)
    for n in (0, 1, 5, 40, 300):
        for spread in (60, 400, 3000):
            boxes = []
            for _ in range(n):
                x, y = r.uniform(-spread, spread), r.uniform(-spread, spread)
                w, h = (r.choice([0.0, 1.0, 20.0, r.choice([80.0, 1e7])]) for _ in range(2))
                boxes.append((x, y, x + w, y + h))
            if n == 40:
                boxes[7] = (0.0, 0.0, float("inf"), 5.0)
            for reach in (8.0, 12.0):
                assert K.clusters(boxes, reach) == literal_clusters(boxes, reach)


def test_many_clusters_take_linear_time():
    import time

    took = []
    for n in (40, 160):
        boxes = [(30.0 * i, 30.0 * j, 30.0 * i + 10, 30.0 * j + 10) for i in range(n) for j in range(100)]
        began = time.process_time()
        assert len(K.clusters(boxes, 12.0)) == len(boxes)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_booktabs_table_and_chart():
    text = K.Block(False, (100, 105, 480, 118), "cells here", 9.0, sizes=[(9.0, 10)])
    prose = K.Block(False, (60, 300, 540, 380), "long prose " * 30, 9.0, sizes=[(9.0, 330)])
    caption = K.Block(False, (100, 125, 480, 140), "Table 4: numbers", 9.0, sizes=[(9.0, 14)])
    rules = [((90.0, y, 490.0, y + 0.5), False) for y in (100.0, 104.0, 120.0)]
    chart = [((100.0, 500.0, 300.0, 501.0), False), ((100.0, 420.0, 101.0, 501.0), False)] + [((110.0 + 20 * i, 450.0, 120.0 + 20 * i, 500.0), False) for i in range(6)]
    tick = K.Block(False, (110, 503, 120, 510), "12", 6.0, sizes=[(6.0, 2)])
    out = K.arrange([text, prose, caption, tick], [*rules, *chart], 612.0)
    images = [b for b in out if b.image]
    assert sorted(b.kind or "figure" for b in images) == ["figure", "table"]
    assert {b.text for b in out if not b.image} == {prose.text, caption.text}
    assert {t for b in images for t in b.absorbed} == {"cells here", "12"}


def test_single_rule_scan_and_highlight():
    assert K.ruled_tables([(50, 100, 500, 101)], 612, [(60, 90, 200, 99)], []) == []
    assert K.ruled_tables([(50, 100, 500, 101), (50, 150, 500, 151)], 612, [], []) == []
    code = [(60.0, 100.0 + 14 * i, 360.0, 112.0 + 14 * i) for i in range(4)]
    assert K.vector_figures(code, code) == []


def test_equation_fragments_join_within_reach_only():
    def part(x, y):
        return K.measured(K.Block(False, (x, y, x + 10, y + 8), f"{x:g}", chars=(2, 0, 2, 0), spans=[(10.0, 2)], sizes=[(10.0, 2)]))

    near = [part(100 + 12 * i, 400 + (i % 2) * 5) for i in range(10)]
    assert [b.box for b in K.merge_equations(near)] == [(100, 400, 218, 413)]
    assert len(K.merge_equations([part(100, 100), part(100, 300)])) == 2
    assert len(K.merge_equations([part(260, 100), part(330, 100)])) == 2


def test_growth_ends_on_empty_boxes():
    blocks = [K.Block(True, (0, 0, 50, 50)), K.Block(False, (60, 10, 60, 10), "x", 6.0, sizes=[(6.0, 1)])]
    K.grow_figures(blocks)
    assert blocks[0].box == (0, 0, 60, 50)


def test_image_fragments(spark):
    t = [420.9, 0.0, -0.0, 554.3, 87.2, 133.7]
    rows = [("p", 0, i, 221.5 + i, 140.0, 240.0 + i, 610.0, t) for i in range(26)]
    rows += [("p", 0, 50, 0.0, 0.0, 9.0, 9.0, [1.0] * 6), ("p", 0, 51, 0.0, 0.0, 9.0, 9.0, None)]
    df = spark.createDataFrame(rows, "paper_id string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, transform array<double>")
    got = sorted((r.block_no, r.x0, r.x1) for r in B.merge_image_fragments(df).collect())
    assert got == [(0, 221.5, 265.0), (50, 0.0, 9.0), (51, 0.0, 9.0)]


def _random_page(r, n):
    images = [K.Block(True, (x, y, x + r.randint(40, 200), y + r.randint(30, 150))) for x, y in ((r.randint(0, 400), r.randint(0, 600)) for _ in range(3))]
    words = ["Figure 1: a", "Table 2: b", "body text of a page", "x"]
    texts = [K.Block(False, (x, y, x + r.randint(10, 200), y + r.randint(5, 30)), r.choice(words)) for x, y in ((r.randint(0, 400), r.randint(0, 700)) for _ in range(n))]
    return images, texts


def test_relational_steps_equal_kernels(spark):
    r = random.Random(2)
    t_rows, a_rows, d_rows, want_kept, want_kind, want_tables = [], [], [], set(), set(), set()
    for page in range(60):
        images, texts = _random_page(r, 8)
        rules = [(float(r.randint(0, 200)), y, float(r.randint(250, 600)), y + 1) for y in sorted(r.sample(range(50, 700), 6))]
        rules = [tuple(map(float, x)) for x in rules]
        key = ("p", page)
        t_rows += [(*key, i, *map(float, b.box), b.text) for i, b in enumerate(texts)]
        a_rows += [(*key, 100 + i, *map(float, b.box)) for i, b in enumerate(images)]
        d_rows += [(*key, i, *b, False) for i, b in enumerate(rules)]
        want_tables |= {(page, *b) for b in K.ruled_tables(rules, 612.0, [b.box for b in texts], [b.box for b in images])}
        both = [*images, *texts]
        place = {id(b): i for i, b in enumerate(texts)} | {id(b): 100 + i for i, b in enumerate(images)}
        K.label_by_captions(both)
        want_kind |= {(page, place[id(b)], b.kind) for b in images if b.kind}
        want_kept |= {(page, place[id(b)]) for b in K.absorb_texts(both) if not b.image}
    box = "x0 double, y0 double, x1 double, y1 double"
    texts = spark.createDataFrame(t_rows, f"paper_id string, page int, pos int, {box}, text string")
    arts = spark.createDataFrame(a_rows, f"paper_id string, page int, pos int, {box}")
    draws = spark.createDataFrame(d_rows, f"paper_id string, page int, draw_no int, {box}, is_infinite boolean")
    pages = spark.createDataFrame([("p", i, 612.0, 792.0) for i in range(60)], "paper_id string, page int, width double, height double")
    kept, _ = layout.absorb(texts, arts)
    assert {(x.page, x.pos) for x in kept.collect()} == want_kept
    assert {(x.page, x.pos, x.kind) for x in layout.caption_kinds(texts, arts).collect()} == want_kind
    tables = layout.ruled_tables(layout.table_rules(draws, pages, arts), texts)
    assert {(x.page, x.x0, x.y0, x.x1, x.y1) for x in tables.collect()} == want_tables


def test_reading_order_equals_a_literal_fold(spark):
    r = random.Random(3)
    edges = [0.0, 306.0, 612.0]
    rows, want = [], []

    def column(x):
        return 0 if x < 306 else 1

    for page in range(80):
        blocks = []
        for pos in range(10):
            x0 = r.choice([54.0, 321.0])
            x1 = 558.0 if r.random() < 0.25 else x0 + 237
            blocks.append((pos, x0, float(r.randint(0, 9) * 50), x1))
        rows += [("p", page, pos, x0, y0, x1, y0 + 20) for pos, x0, y0, x1 in blocks]
        band, order = [], []
        for b in sorted(blocks, key=lambda b: b[2]):
            if column(b[1] + 1) != column(b[3] - 1):
                order += sorted(band, key=lambda b: (column((b[1] + b[3]) / 2), b[2]))
                order.append(b)
                band = []
            else:
                band.append(b)
        order += sorted(band, key=lambda b: (column((b[1] + b[3]) / 2), b[2]))
        want += [(page, b[0]) for b in order]
    df = spark.createDataFrame(rows, "paper_id string, page int, pos int, x0 double, y0 double, x1 double, y1 double")
    e = spark.createDataFrame([("p", i, edges) for i in range(80)], "paper_id string, page int, edges array<double>")
    got = O.reading_order(df, e).orderBy("order_index").collect()
    assert [(x.page, x.pos) for x in got] == want


def _chunks_by_hand(regions):
    """The cut rule and the folding of short chunks, one region after another."""
    chunks, buf, size = [], [], 0

    def close():
        nonlocal buf, size
        if buf:
            chunks.append((False, buf))
        buf, size = [], 0

    for x in regions:
        if x["kind"] == "caption":
            close()
            chunks.append((True, [x]))
        elif x["kind"] in ("heading", "body") and x["text"].strip():
            if buf and (x["section"] != buf[0]["section"] or x["kind"] == "heading" or size + len(x["text"]) > 1200):
                close()
            buf.append(x)
            size += len(x["text"])
    close()
    out = []
    for alone, members in chunks:
        text = "\n".join(x["text"] for x in members if x["text"].strip())
        pages = [x["page"] for x in members]
        if out and not alone and len(text) < 120 and out[-1]["section"] == members[0]["section"]:
            last = out[-1]
            last["boxed"] = last["boxed"] and last["end"] == max(pages)
            last["text"] += "\n" + text
            last["end"] = max(pages)
        else:
            out.append({"section": members[0]["section"], "text": text, "end": max(pages), "boxed": min(pages) == max(pages)})
    return [(c["section"], c["text"], c["end"], c["boxed"]) for c in out]


def test_chunks_equal_a_literal_fold(spark):
    r = random.Random(4)
    rows, want = [], {}
    for p in range(60):
        regions, page = [], 0
        for _ in range(r.randint(0, 40)):
            page += r.random() < 0.15
            regions.append({
                "kind": r.choice(["body", "body", "body", "heading", "caption", "figure", "equation"]),
                "section": r.choice(["method", "results"]) if r.random() < 0.2 or not regions else regions[-1]["section"],
                "text": r.choice(["", " ", "x" * 20, "y" * 130, "z" * 700, "w" * 1300]),
                "page": int(page),
            })
        want[f"p{p}"] = _chunks_by_hand(regions)
        for i, x in enumerate(regions):
            rows.append((f"p{p}", x["kind"], (x["page"], 0.0, 0.0, 1.0, 1.0), x["text"], i, x["section"], "t"))
    df = spark.createDataFrame(
        rows, "paper_id string, region_type string, bbox struct<page:int,x0:double,y0:double,x1:double,y1:double>, text string, order_index int, section string, section_title_raw string"
    )
    got = {}
    for x in chunking.chunk_regions(df.repartition(7)).orderBy("order_index").collect():
        got.setdefault(x.paper_id, []).append((x.section, x.text, x.page_end, x.bbox is not None))
    assert got == {k: v for k, v in want.items() if v}


def test_titles(spark):
    def paper(pid, *lines):
        return [
            (f"{pid}", kind, text, size, (0, 50.0, y, x1, y + size), i, "title" if i < 90 else "abstract")
            for i, (kind, text, size, y, x1) in enumerate(lines)
        ]

    rows = [
        *paper("two", ("heading", "Retrieval for", 17.0, 100.0, 400.0), ("heading", "Hard Tasks", 17.0, 120.0, 400.0), ("body", "Authors", 10.5, 150.0, 300.0)),
        *paper("sub", ("heading", "Main", 17.0, 100.0, 400.0), ("heading", "A subtitle", 9.0, 120.0, 400.0)),
        *paper("far", ("heading", "Banner", 12.0, 20.0, 400.0), ("heading", "Title", 12.0, 270.0, 400.0)),
        *paper("caps", ("body", "by someone", 12.0, 90.0, 400.0), ("body", "A STUDY OF", 12.0, 110.0, 400.0), ("body", "LAYOUTS", 12.0, 130.0, 400.0)),
        *paper("none", ("body", "lower only", 12.0, 110.0, 400.0)),
        *paper("stamp", ("heading", "arXiv:1", 20.0, 100.0, 55.0), ("heading", "Real", 17.0, 100.0, 400.0)),
    ]
    df = spark.createDataFrame(
        rows, "paper_id string, region_type string, text string, font_size double, bbox struct<page:int,x0:double,y0:double,x1:double,y1:double>, order_index int, section string"
    )
    got = {r.paper_id: r.title for r in sections.paper_titles(df).collect()}
    assert got == {"two": "Retrieval for Hard Tasks", "sub": "Main", "far": "Banner", "caps": "A STUDY OF LAYOUTS", "none": "", "stamp": "Real"}


def test_font_measures(spark):
    rows = [("p", 0, b, 0, i, 0.0, 0.0, 1.0, 1.0, t, f, 9.0) for b, spans in enumerate([
        [("p" * 170, "Times"), ("m" * 7, "CMMI10")], [("a" * 4, "CMBX10"), ("b" * 4, "CMR10"), ("c" * 4, "CMMI7")],
        [("a" * 400, "CMR10"), ("b" * 2, "CMMI10")], [("plain", "CMR10")],
    ]) for i, (t, f) in enumerate(spans)]
    cols = "paper_id string, page int, block_no int, line_no int, span_no int, bx0 double, by0 double, bx1 double, by1 double, text string, font string, size double"
    got = [r.math_ratio for r in B.text_blocks(spark.createDataFrame(rows, cols)).orderBy("block_no").collect()]
    assert got[0] < 0.1 and got[1] == 1.0 and got[2] < 0.05 and got[3] == 0.0


def test_body_size_is_the_weighted_median(spark):
    r = random.Random(5)
    rows, want = [], {}
    for page in range(40):
        sizes = [(float(r.randint(6, 14)), r.randint(1, 30)) for _ in range(r.randint(1, 9))]
        want[page] = K.weighted_median(sizes)
        rows.append(("p", page, sizes))
    df = spark.createDataFrame(rows, "paper_id string, page int, sizes array<struct<size:double,chars:int>>")
    assert {x.page: x.body_size for x in B.body_sizes(df).collect()} == want
    assert B.body_sizes(df.withColumn("sizes", F.array().cast("array<struct<size:double,chars:int>>"))).count() == 0


def test_page_measures_equal_relational_steps(spark):
    r = random.Random(22)
    pages, blocks = [], []
    for p in range(60):
        width = r.choice([612.0, 595.5, 300.0])
        pages.append((f"p{p % 7}", p, width, 792.0))
        for i in range(r.choice([0, 1, 6, 30])):
            x = r.choice([54.0, 54.0, 321.0, r.uniform(-20, width)])
            y, w, h = r.uniform(0, 700), r.choice([237.0, 237.0, 500.0, 0.0, r.uniform(0, 90)]), r.choice([10.0, 40.5, 0.0])
            sizes = r.choice([None, [], [(9.0, 30)], [(9.0, 3), (12.0, 3)], [(8.5, 7), (7.0, 0)]])
            blocks.append((f"p{p % 7}", p, i, x, y, x + w, y + h, sizes))
    pages = spark.createDataFrame(pages, "paper_id string, page int, width double, height double")
    blocks = spark.createDataFrame(blocks, "paper_id string, page int, pos int, x0 double, y0 double, x1 double, y1 double, sizes array<struct<size:double,chars:int>>")
    edges = {(x.paper_id, x.page): x.edges for x in O.edges(O.gutters(blocks, pages), pages).collect()}
    body = {(x.paper_id, x.page): x.body_size for x in B.body_sizes(blocks).collect()}
    got = layout.page_measures(blocks, pages).collect()
    assert len(got) == 60 and sum(len(x.edges) > 2 for x in got) > 5
    for x in got:
        assert x.edges == edges[x.paper_id, x.page]
        assert x.body_size == (body.get((x.paper_id, x.page)) or K.DEFAULT_BODY_SIZE)
