"""Synthetic decoded pages from the ``documents`` table.

Driver texts have no pages, headings or references, so lines are laid out by arithmetic
on their number, twelve to a page in two columns, with integer coordinates. This is
test input and says nothing about real papers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_PAGE = 12
WIDTH, HEIGHT = 612.0, 792.0
HEADINGS = (
    "Abstract", "Introduction", "Related Work", "Our Proposed Approach", "Results", "Discussion", "Conclusion",
    "References", "Appendix", "Data and Model Analysis", "Miscellany",
)


def lines(documents: DataFrame) -> DataFrame:
    """(paper_id, i, raw): a document's lines, numbered from 0."""
    return _numbered(documents, F.split("text", "\n"))


def _numbered(documents: DataFrame, raw: Column) -> DataFrame:
    return documents.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("paper_id"), F.posexplode(raw).alias("i", "raw"))


def _with_headings(documents: DataFrame) -> DataFrame:
    """``lines``, those whose place a heading takes moved to the end of the line before."""
    split = F.split("text", "\n")
    moved = lambda all_: F.transform(all_, lambda x, i: F.when((i % 9 == 8) & (i + 1 < F.size(all_)), F.concat(x, F.lit(" "), F.get(all_, i + 1))).otherwise(x))
    return _numbered(documents, F.get(F.transform(F.array(split), moved), 0))


def _role() -> Column:
    i = F.col("i")
    return (
        F.when(i % 9 == 0, "heading").when(i % 12 == 5, "caption").when(i % 5 == 2, "citing").otherwise("body")
    )


def text_rows(documents: DataFrame) -> DataFrame:
    """(paper_id, page, pos, i, role, x0 .. y1, text, font_size, bold_ratio) of each line that
    isn't blank. The first line is a title; every ninth place has a heading, and its line goes to the end of
    the one before; every third heading spans both columns; pages name figures and tables in turn."""
    i, page = F.col("i"), F.floor(F.col("i") / PER_PAGE).cast("int")
    slot = F.col("i") % PER_PAGE
    column, row = F.floor(slot / 6).cast("int"), slot % 6
    k = F.floor(i / 9).cast("int")
    names = F.array(*[F.lit(h) for h in HEADINGS])
    word = F.when(page % 2 == 0, "Figure").otherwise("Table")
    number = (page + 1).cast("string")
    text = (
        F.when(i == 0, F.col("raw"))
        .when(F.col("role") == "heading", F.concat((k + 1).cast("string"), F.lit(". "), F.get(names, k % len(HEADINGS))))
        .when(F.col("role") == "caption", F.concat(word, F.lit(" "), number, F.lit(": "), F.col("raw")))
        .when(F.col("role") == "citing", F.concat(F.col("raw"), F.lit(" as shown in "), word, F.lit(" "), number))
        .otherwise(F.col("raw"))
    )
    heading = F.col("role") == "heading"
    left = F.when(column == 0, 54.0).otherwise(321.0)
    spans = heading & (i % 27 == 0)
    rows = _with_headings(documents).withColumn("role", _role()).select(
        "paper_id",
        page.alias("page"),
        (slot * 2).cast("int").alias("pos"),
        "i",
        "role",
        F.when(spans, 54.0).otherwise(left).alias("x0"),
        (F.lit(100.0) + row * 80).alias("y0"),
        F.when(spans, 558.0).otherwise(left + 237).alias("x1"),
        (F.lit(140.0) + row * 80).alias("y1"),
        text.alias("text"),
        F.when(heading, 12.0).otherwise(9.0).alias("font_size"),
        F.when(heading, 1.0).otherwise(0.0).alias("bold_ratio"),
    )
    return rows.filter(F.col("text").rlike(r"(?U)\S"))


def figure_rows(documents: DataFrame) -> DataFrame:
    """(paper_id, page, pos, i, x0 .. y1): a box below each caption."""
    return text_rows(documents).filter("role = 'caption'").select(
        "paper_id",
        "page",
        (F.col("pos") + 1).alias("pos"),
        "i",
        "x0",
        F.lit(550.0).alias("y0"),
        "x1",
        F.lit(640.0).alias("y1"),
    )


def pages(documents: DataFrame) -> DataFrame:
    """The page table: pages up to a document's last line."""
    last = F.floor((F.size(F.split("text", "\n")) - 1) / PER_PAGE).cast("int")
    return documents.filter("text is not null").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("paper_id"),
        F.explode(F.sequence(F.lit(0), last)).alias("page"),
        F.lit(WIDTH).alias("width"),
        F.lit(HEIGHT).alias("height"),
    )


def flat(documents: DataFrame) -> DataFrame:
    """(paper_id, page, text): twelve lines a page, each with its line end."""
    page = F.floor(F.col("i") / PER_PAGE).cast("int")
    one = F.array_sort(F.collect_list(F.struct("i", "raw")))
    return (
        lines(documents)
        .groupBy("paper_id", page.alias("page"))
        .agg(F.concat(F.array_join(F.transform(one, lambda x: x["raw"]), "\n"), F.lit("\n")).alias("text"))
    )


def spans(documents: DataFrame) -> DataFrame:
    """Decoded spans: a line's text, and after every seventh line a formula in a maths face."""
    rows = text_rows(documents)
    face = F.when(F.col("role") == "heading", "Times-Bold").when(F.col("i") % 4 == 1, "CMR9").otherwise("Times-Roman")
    first = F.struct(F.lit(0).alias("span_no"), F.col("text").alias("text"), face.alias("font"), F.col("font_size").alias("size"))
    second = F.struct(F.lit(1).alias("span_no"), F.lit(" x + y = 1").alias("text"), F.lit("CMMI10").alias("font"), F.lit(7.0).alias("size"))
    both = F.when(F.col("i") % 7 == 3, F.array(first, second)).otherwise(F.array(first))
    return rows.select(
        "paper_id", "page", F.col("pos").alias("block_no"), F.lit(0).alias("line_no"),
        *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(both).alias("s"),
    ).select("paper_id", "page", "block_no", "line_no", "s.span_no", "bx0", "by0", "bx1", "by1", "s.text", "s.font", "s.size")


def images(documents: DataFrame) -> DataFrame:
    """Decoded images: the box below each caption in two halves of one placement."""
    half = F.explode(F.array(F.lit(0), F.lit(1))).alias("h")
    rows = figure_rows(documents).select("paper_id", "page", "pos", "x0", "x1", half)
    middle = (F.col("x0") + F.col("x1")) / 2
    place = [F.lit(237.0), F.lit(0.0), F.lit(-0.0), F.lit(90.0), F.col("x0"), F.lit(550.0) + F.col("h") * 0.01]
    return rows.select(
        "paper_id",
        "page",
        (F.col("pos") + F.col("h") * 100).alias("block_no"),
        F.when(F.col("h") == 0, F.col("x0")).otherwise(middle).alias("x0"),
        F.lit(550.0).alias("y0"),
        F.when(F.col("h") == 0, middle).otherwise(F.col("x1")).alias("x1"),
        F.lit(640.0).alias("y1"),
        F.array(*place).alias("transform"),
    )


def drawings(documents: DataFrame) -> DataFrame:
    """Decoded drawings: a rule above every fourth line, and an axis through each figure."""
    rules = text_rows(documents).filter("i % 4 = 0").select(
        "paper_id", "page", F.col("pos").alias("draw_no"), "x0", (F.col("y0") - 2).alias("y0"), "x1", (F.col("y0") - 1).alias("y1")
    )
    axes = figure_rows(documents).select(
        "paper_id", "page", (F.col("pos") + 100).alias("draw_no"), "x0", F.lit(630.0).alias("y0"), "x1", F.lit(631.0).alias("y1")
    )
    return rules.unionByName(axes).withColumn("is_infinite", F.lit(False))


def bars(documents: DataFrame) -> DataFrame:
    """Decoded drawings: four bars inside each figure's box."""
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    rows = figure_rows(documents).select("paper_id", "page", "pos", "x0", k)
    return rows.select(
        "paper_id", "page", (F.col("pos") * 10 + F.col("k")).alias("draw_no"), (F.col("x0") + 10 + F.col("k") * 30).alias("x0"), F.lit(560.0).alias("y0"),
        (F.col("x0") + 30 + F.col("k") * 30).alias("x1"), F.lit(630.0).alias("y1"), F.lit(False).alias("is_infinite"),
    )


def formulas(documents: DataFrame) -> DataFrame:
    """Text blocks: every seventh line as three fragments of a formula, other lines as they are."""
    rows = text_rows(documents)
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(("x", "+", "y"))]))
    maths = rows.filter("i % 7 = 3").withColumn("f", parts)
    maths = maths.select(
        "paper_id", "page", (F.col("pos") * 10 + F.col("f.k")).alias("pos"), (F.col("x0") + F.col("f.k") * 20).alias("x0"), "y0",
        (F.col("x0") + F.col("f.k") * 20 + 12).alias("x1"), "y1", F.col("f.t").alias("text"), F.lit(1.0).alias("math_ratio"),
    )
    plain = rows.filter("i % 7 <> 3").select("paper_id", "page", (F.col("pos") * 10).alias("pos"), "x0", "y0", "x1", "y1", "text", F.lit(0.0).alias("math_ratio"))
    return maths.unionByName(plain)


class Synthetic:
    """All decoded tables of ``documents``, for ``pipeline.run_pipeline``."""

    def __init__(self, documents: DataFrame):
        self.pages, self.flat, self.spans = pages(documents), flat(documents), spans(documents)
        self.images, self.drawings = images(documents), drawings(documents)
        name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
        lines_ = F.size(F.split("text", "\n"))
        self.docs = documents.filter("text is not null").select(
            name.alias("paper_id"),
            F.concat(name, F.lit(".pdf")).alias("source_filename"),
            F.encode("text", "UTF-8").alias("content"),
            F.lit(None).cast("string").alias("meta_title"),
            (F.floor((lines_ - 1) / PER_PAGE) + 1).cast("int").alias("page_count"),
        )
