"""Layout: decoded pages to regions in reading order.

A page is one row of arrays; one map over page rows runs the kernels, and everything
before and after is relational. All groupings are by paper or by paper and page, so rows
are dealt out once by page and once by paper.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import blocks as B
from quire.operators import columns as O
from quire.operators import kernels as K
from quire.operators.blocks import PAGE
from quire.sources.shared import ship, written

_BLOCK = (
    "array<struct<image:boolean,x0:double,y0:double,x1:double,y1:double,text:string,font_size:double,"
    "bold_ratio:double,math_ratio:double,kind:string,sizes:array<struct<size:double,chars:int>>>>"
)


def page_rows(spans: DataFrame, images: DataFrame, drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per page with arrays of its blocks (in native order, page numbers left out,
    image fragments united) and drawings."""
    text = B.drop_furniture(B.text_blocks(spans), pages).filter(F.col("text") != "")
    text = text.select(
        *PAGE,
        "block_no",
        F.struct(
            F.lit(False).alias("image"), "x0", "y0", "x1", "y1", "text", "font_size", "bold_ratio", "math_ratio", "sizes",
            F.transform(
                F.filter("spans", lambda s: s["chars"] > 0),
                lambda s: F.struct(F.bround(s["size"], 1).alias("size"), s["n"].alias("n")),
            ).alias("spans"),
            F.array(*[F.col(f"{c}_chars").cast("int") for c in ("total", "bold", "math", "weak")]).alias("chars"),
        ).alias("b"),
    )
    merged = B.merge_image_fragments(images)
    null = lambda t: F.lit(None).cast(t)
    pictures = merged.select(
        *PAGE,
        "block_no",
        F.struct(
            F.lit(True).alias("image"), "x0", "y0", "x1", "y1", F.lit("").alias("text"), null("double").alias("font_size"),
            F.lit(0.0).alias("bold_ratio"), F.lit(0.0).alias("math_ratio"), null("array<struct<size:double,chars:int>>").alias("sizes"),
            null("array<struct<size:double,n:int>>").alias("spans"), null("array<int>").alias("chars"),
        ).alias("b"),
    )
    blocks = (
        text.unionByName(pictures)
        .groupBy(*PAGE)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "b"))), lambda x: x["b"]).alias("blocks"))
    )
    drawn = (
        drawings.groupBy(*PAGE)
        .agg(F.array_sort(F.collect_list(F.struct("draw_no", "x0", "y0", "x1", "y1", F.coalesce("is_infinite", F.lit(False)).alias("endless")))).alias("drawings"))
    )
    return pages.join(blocks, PAGE, "left").join(drawn, PAGE, "left").filter("blocks is not null or drawings is not null")


def _pieces(batches: Iterator[pa.RecordBatch], pages: int = 32) -> Iterator[pa.RecordBatch]:
    """A few pages at a time, so that a worker holds no more of them as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, pages):
            yield batch.slice(start, pages)


def page_blocks(rows: DataFrame) -> DataFrame:
    """(paper_id, page, pos, and a block's columns): what the kernels make of each page."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out = []
            for row in batch.to_pylist():
                blocks = [_block(b) for b in row["blocks"] or ()]
                drawings = [((d["x0"], d["y0"], d["x1"], d["y1"]), d["endless"]) for d in row["drawings"] or ()]
                made = K.arrange(blocks, drawings, row["width"])
                out.append({"paper_id": row["paper_id"], "page": row["page"], "made": [_row(b) for b in made]})
            yield pa.RecordBatch.from_pylist(out, _MADE)

    mapped = rows.select(*PAGE, "width", "blocks", "drawings").mapInArrow(run, f"paper_id string, page int, made {_BLOCK}")
    return mapped.select(*PAGE, F.posexplode("made").alias("pos", "b")).select(*PAGE, "pos", "b.*")


_MADE = pa.schema(
    [
        ("paper_id", pa.string()),
        ("page", pa.int32()),
        (
            "made",
            pa.list_(
                pa.struct(
                    [
                        ("image", pa.bool_()),
                        *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1")),
                        ("text", pa.string()),
                        *((c, pa.float64()) for c in ("font_size", "bold_ratio", "math_ratio")),
                        ("kind", pa.string()),
                        ("sizes", pa.list_(pa.struct([("size", pa.float64()), ("chars", pa.int32())]))),
                    ]
                )
            ),
        ),
    ]
)


def _block(b: dict) -> K.Block:
    box = (b["x0"], b["y0"], b["x1"], b["y1"])
    if b["image"]:
        return K.Block(True, box)
    total, bold, strong, weak = b["chars"]
    return K.Block(
        False,
        box,
        b["text"],
        b["font_size"],
        b["bold_ratio"],
        b["math_ratio"],
        sizes=[(s["size"], s["chars"]) for s in b["sizes"]],
        chars=(total, bold, strong, weak),
        spans=[(s["size"], s["n"]) for s in b["spans"]],
    )


def _row(b: K.Block) -> dict:
    return {
        "image": b.image,
        **dict(zip(("x0", "y0", "x1", "y1"), b.box, strict=True)),
        "text": "\n".join(b.absorbed) if b.image else b.text,
        "font_size": None if b.image else b.font_size,
        "bold_ratio": 0.0 if b.image else b.bold_ratio,
        "math_ratio": 0.0 if b.image else b.math_ratio,
        "kind": b.kind,
        "sizes": [{"size": s, "chars": n} for s, n in b.sizes],
    }


_BOXES = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"


def _per_page(rows: DataFrame, make) -> DataFrame:
    """(paper_id, page, x0, y0, x1, y1, text) of what ``make(row)`` gives for each page row."""
    ship(rows.sparkSession)
    kind = pa.struct([*((c, pa.float64()) for c in ("x0", "y0", "x1", "y1")), ("text", pa.string())])
    schema = pa.schema([("paper_id", pa.string()), ("page", pa.int32()), ("made", pa.list_(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out = []
            for row in batch.to_pylist():
                made = [dict(zip(("x0", "y0", "x1", "y1", "text"), (*box, text), strict=True)) for box, text in make(row)]
                out.append({"paper_id": row["paper_id"], "page": row["page"], "made": made})
            yield pa.RecordBatch.from_pylist(out, schema)

    mapped = rows.mapInArrow(run, f"paper_id string, page int, made {_BOXES}")
    return mapped.select(*PAGE, F.explode("made").alias("b")).select(*PAGE, "b.*")


def figure_boxes(drawings: DataFrame, texts: DataFrame) -> DataFrame:
    """(paper_id, page, x0, y0, x1, y1) of the figures that a page's paths make."""
    box = ("x0", "y0", "x1", "y1")
    d = drawings.filter(~F.coalesce("is_infinite", F.lit(False))).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("draw_no", *box))).alias("drawings"))
    t = texts.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*box))).alias("texts"))

    def make(row: dict) -> list:
        boxes = lambda name: [tuple(x[c] for c in box) for x in row[name] or ()]
        return [(b, None) for b in K.vector_figures(boxes("drawings"), boxes("texts"))]

    return _per_page(d.join(t, PAGE, "left").select(*PAGE, "drawings", "texts"), make).drop("text")


def equation_boxes(blocks: DataFrame) -> DataFrame:
    """(paper_id, page, x0, y0, x1, y1, text) of a page's texts once formulas are joined.
    blocks: text blocks with ``pos`` and ``math_ratio``."""
    one = F.struct("pos", "x0", "y0", "x1", "y1", "text", "math_ratio")
    rows = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("blocks"))

    def make(row: dict) -> list:
        own = [K.Block(False, (b["x0"], b["y0"], b["x1"], b["y1"]), b["text"], math_ratio=b["math_ratio"]) for b in row["blocks"]]
        return [(b.box, b.text) for b in K.merge_equations(own)]

    return _per_page(rows, make)


def page_measures(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, page, edges, body_size) of every page: its columns' borders and its body size.

    Boxes and sizes of a page meet in one row, without texts, and one map works both out; the steps by
    themselves are ``columns.gutters`` and ``blocks.body_sizes``.
    """
    ship(blocks.sparkSession)
    one = F.struct("x0", "y0", "x1", "y1", "sizes")
    rows = pages.select(*PAGE, "width").join(blocks.groupBy(*PAGE).agg(F.collect_list(one).alias("blocks")), PAGE, "left")
    schema = pa.schema([("paper_id", pa.string()), ("page", pa.int32()), ("edges", pa.list_(pa.float64())), ("body_size", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out = []
            for row in batch.to_pylist():
                own = row["blocks"] or ()
                boxes = [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in own]
                sizes = [(s["size"], s["chars"]) for b in own for s in b["sizes"] or ()]
                out.append({**{c: row[c] for c in PAGE}, "edges": K.column_edges(boxes, row["width"]), "body_size": K.weighted_median(sizes)})
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, "paper_id string, page int, edges array<double>, body_size double")


def to_regions(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The region table (without sections) of arranged blocks, which are read for their pages'
    measures and for themselves, and so are written first."""
    blocks = written(blocks, "blocks")
    ordered = O.reading_order(blocks, page_measures(blocks, pages))
    kind = O.classify(*[F.col(c) for c in ("text", "font_size", "body_size", "image", "math_ratio", "bold_ratio", "kind")])
    return ordered.select(
        F.concat_ws("::", "paper_id", F.lit("region"), F.col("order_index").cast("string")).alias("region_id"),
        "paper_id",
        kind.alias("region_type"),
        F.struct("page", "x0", "y0", "x1", "y1").alias("bbox"),
        "text",
        "column_index",
        "order_index",
        "font_size",
        F.lit("unknown").alias("section"),
        F.lit("").alias("section_title_raw"),
    )


def extract_regions(spans: DataFrame, images: DataFrame, drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions of all papers in reading order, from decoded pages."""
    return to_regions(page_blocks(page_rows(spans, images, drawings, pages)), pages)


# ---- relational forms of single steps -------------------------------------------------


def table_rules(drawings: DataFrame, pages: DataFrame, figures: DataFrame) -> DataFrame:
    """(paper_id, page, y, x0, x1) of the wide thin drawings that are no figure's axis."""
    d, f = G.box("d_"), G.box("f_")
    rules = (
        drawings.join(pages.select(*PAGE, "width"), PAGE)
        .filter((F.col("x1") - F.col("x0") >= F.col("width") * K.RULE_WIDTH) & (F.col("y1") - F.col("y0") <= K.LINE_THICKNESS))
        .select(*PAGE, F.col("y0").alias("d_y0"), F.col("x0").alias("d_x0"), F.col("x1").alias("d_x1"))
    )
    boxes = figures.select(*[F.col(c).alias(f"f_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    on_axis = (
        (F.col("paper_id") == F.col("f_paper_id"))
        & (F.col("page") == F.col("f_page"))
        & F.col("d_y0").between(f[1], f[3])
        & (d[2] > d[0])
        & (G.shared(d[0], d[2], f[0], f[2]) / (d[2] - d[0]) >= K.AXIS_OVERLAP)
    )
    return rules.join(boxes, on_axis, "left_anti").select(
        *PAGE, F.col("d_y0").alias("y"), F.col("d_x0").alias("x0"), F.col("d_x1").alias("x1")
    )


def ruled_tables(rules: DataFrame, texts: DataFrame) -> DataFrame:
    """(paper_id, page, x0, y0, x1, y1): islands of aligned rules with a text between them."""
    order = Window.partitionBy(*PAGE).orderBy("y", "x0", "x1")
    last = lambda c: F.lag(c).over(order)
    shorter = F.least(F.col("x1") - F.col("x0"), last("x1") - last("x0"))
    common = F.least(F.col("x1"), last("x1")) - F.greatest(F.col("x0"), last("x0"))
    joins = (shorter > 0) & (common / shorter > K.RULE_OVERLAP) & (F.col("y") - last("y") <= K.RULE_SPAN)
    starts = rules.withColumn("starts", (~F.coalesce(joins, F.lit(False))).cast("int"))
    groups = (
        starts.withColumn("island", F.sum("starts").over(order))
        .groupBy(*PAGE, "island")
        .agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"))
        .filter(F.col("n") >= K.MIN_RULES)
        .drop("n")
    )
    t = texts.select(*[F.col(c).alias(f"t_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    same_page = (F.col("paper_id") == F.col("t_paper_id")) & (F.col("page") == F.col("t_page"))
    return groups.join(t, same_page & (G.containment(G.box("t_"), G.box()) >= K.ABSORB), "left_semi").drop("island")


def absorb(texts: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts that stay, artifacts with the absorbed ``text``). Both have ``pos``; a text goes
    to the first artifact that holds most of it, captions stay."""
    a = artifacts.select(*[F.col(c).alias(f"a_{c}") for c in (*PAGE, "pos", "x0", "y0", "x1", "y1")])
    same_page = (F.col("paper_id") == F.col("a_paper_id")) & (F.col("page") == F.col("a_page"))
    hosted = (
        texts.filter(~X.is_caption(F.col("text")))
        .join(a, same_page & (G.containment(G.box(), G.box("a_")) >= K.ABSORB))
        .groupBy(*PAGE, "pos")
        .agg(F.min("a_pos").alias("host"), F.first("text").alias("text"))
    )
    left = texts.join(hosted.select(*PAGE, "pos"), [*PAGE, "pos"], "left_anti")
    lines = (
        hosted.filter("text <> ''")
        .groupBy(*PAGE, F.col("host").alias("pos"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("absorbed"))
    )
    return left, artifacts.join(lines, [*PAGE, "pos"], "left").withColumn("absorbed", F.coalesce("absorbed", F.lit("")))


def greedy(pairs_sorted, left: str, right: str):
    """The pairs of a sorted array that are left when each pair takes its two ends."""
    start = F.filter(pairs_sorted, lambda p: F.lit(False))

    def step(kept, p):
        taken = F.exists(kept, lambda k: (k[left] == p[left]) | (k[right] == p[right]))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(pairs_sorted, start, step)


def caption_kinds(texts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(paper_id, page, pos, kind) of the artifacts that a caption decides."""
    rank = Window.partitionBy(*PAGE).orderBy("pos")
    c = texts.filter(X.is_caption(F.col("text"))).withColumn("ci", F.row_number().over(rank))
    c = c.select(*PAGE, "ci", "text", *[F.col(x).alias(f"c_{x}") for x in ("x0", "y0", "x1", "y1")])
    a = artifacts.withColumn("ai", F.row_number().over(rank)).select(*PAGE, "ai", "pos", *[F.col(x).alias(f"a_{x}") for x in ("x0", "y0", "x1", "y1")])
    cb, ab = G.box("c_"), G.box("a_")
    apart = F.greatest(ab[1] - cb[3], cb[1] - ab[3], F.lit(0.0))
    close = (G.shared(cb[0], cb[2], ab[0], ab[2]) / F.greatest(G.width(cb), F.lit(1.0)) >= K.CAPTION_OVERLAP) & (apart <= K.CAPTION_REACH)
    pairs = c.join(a, PAGE).filter(close)
    kind = F.when(X.is_table_caption(F.col("text")), "table").otherwise("figure")
    chosen = pairs.groupBy(*PAGE).agg(
        greedy(F.array_sort(F.collect_list(F.struct(apart.alias("apart"), "ci", "ai", "pos", kind.alias("kind")))), "ci", "ai").alias("p")
    )
    return chosen.select(*PAGE, F.explode("p").alias("p")).select(*PAGE, "p.pos", "p.kind")
