"""Blocks from decoded spans and images: text, fonts, and page furniture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

PAGE = ["paper_id", "page"]
# fixed values
PAGE_MARGIN = 72.0
MAX_EQUATION_CHARS = 200
DEFAULT_BODY_SIZE = 10.0


def text_blocks(spans: DataFrame) -> DataFrame:
    """One row per text block, with the measures that its classification needs.

    Spans meet once, grouped by block: their chars by bold and maths face, the sizes'
    totals and the ordered text all come from one aggregation.
    """
    bare = F.length(X.strip(F.col("text")))
    chars = F.when(X.is_blank(F.col("text")), 0).otherwise(bare)
    strong = X.is_math(F.col("font"))
    one = F.struct("line_no", "span_no", "text", "size", chars.alias("chars"), F.length("text").alias("n"))
    per = lambda cond: F.sum(F.when(cond, F.col("chars")).otherwise(0))
    grouped = (
        spans.withColumn("chars", chars)
        .groupBy(*PAGE, "block_no")
        .agg(
            *[F.first(f"b{c}").alias(c) for c in ("x0", "y0", "x1", "y1")],
            F.array_sort(F.collect_list(one)).alias("spans"),
            F.sum("chars").alias("total_chars"),
            per(X.is_bold(F.col("font"))).alias("bold_chars"),
            per(strong).alias("math_chars"),
            per(~strong & X.is_weak_math(F.col("font"))).alias("weak_chars"),
        )
    )
    return grouped.select(
        *PAGE,
        "block_no",
        "x0",
        "y0",
        "x1",
        "y1",
        block_text(F.col("spans")).alias("text"),
        dominant_size(F.col("spans")).alias("font_size"),
        bold_ratio(F.col("bold_chars"), F.col("total_chars")).alias("bold_ratio"),
        math_ratio(F.col("math_chars"), F.col("weak_chars"), F.col("total_chars")).alias("math_ratio"),
        F.transform(F.filter("spans", lambda s: s["chars"] > 0), lambda s: F.struct(s["size"].alias("size"), s["chars"].alias("chars"))).alias("sizes"),
        "spans",
        "total_chars",
        "bold_chars",
        "math_chars",
        "weak_chars",
    )


def block_text(spans: Column) -> Column:
    """Spans one after another, a line end after each line, stripped."""
    pieces = F.transform(
        spans,
        lambda s, i: F.concat(
            F.when((i > 0) & (F.get(spans, i - 1)["line_no"] != s["line_no"]), F.lit("\n")).otherwise(F.lit("")),
            F.coalesce(s["text"], F.lit("")),
        ),
    )
    return X.strip(F.array_join(pieces, ""))


def dominant_size(spans: Column) -> Column:
    """The size, to a tenth, that sets most characters; the first seen wins ties."""
    sized = F.transform(
        F.filter(spans, lambda s: s["chars"] > 0),
        lambda s: F.struct(F.bround(s["size"], 1).alias("size"), s["n"].alias("n")),
    )
    distinct = F.array_distinct(F.transform(sized, lambda s: s["size"]))
    totals = F.transform(
        distinct,
        lambda z, i: F.struct(
            F.aggregate(F.filter(sized, lambda s: s["size"] == z), F.lit(0), lambda a, s: a + s["n"]).alias("n"),
            (-i).alias("first"),
            z.alias("size"),
        ),
    )
    return F.array_max(totals)["size"]


def bold_ratio(bold: Column, total: Column) -> Column:
    return F.when(total > 0, bold / total).otherwise(0.0)


def math_ratio(strong: Column, weak: Column, total: Column) -> Column:
    """Ambiguous faces count in short blocks that have maths for certain."""
    short = (strong > 0) & (total <= MAX_EQUATION_CHARS)
    return F.when(total > 0, F.when(short, strong + weak).otherwise(strong) / total).otherwise(0.0)


def is_furniture(page_height: Column) -> Column:
    """A page number in the top or bottom margin."""
    return X.is_page_number(F.col("text")) & ((F.col("y1") <= PAGE_MARGIN) | (F.col("y0") >= page_height - PAGE_MARGIN))


def drop_furniture(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Text blocks without page numbers. Measures of the page come after this."""
    heights = pages.select(*PAGE, F.col("height").alias("page_height"))
    return blocks.join(heights, PAGE).filter(~is_furniture(F.col("page_height"))).drop("page_height")


def merge_image_fragments(images: DataFrame) -> DataFrame:
    """One row per placement: pieces that share a transform to a tenth are united at the
    first piece's place; pieces without one stay as they are."""
    # adding zero turns -0.0 into 0.0, which would else be another key
    key = F.transform("transform", lambda v: F.bround(v, 1) + F.lit(0.0))
    whole = (
        images.filter("transform is not null")
        .groupBy(*PAGE, key.alias("key"))
        .agg(
            F.min("block_no").alias("block_no"),
            F.min("x0").alias("x0"),
            F.min("y0").alias("y0"),
            F.max("x1").alias("x1"),
            F.max("y1").alias("y1"),
        )
        .drop("key")
    )
    return whole.unionByName(images.filter("transform is null").select(*whole.columns))


def body_sizes(blocks: DataFrame) -> DataFrame:
    """(paper_id, page, body_size): the median size, a size counting once per character.

    blocks: rows with ``sizes``, an array of (size, chars).
    """
    return (
        blocks.select(*PAGE, F.explode("sizes").alias("s"))
        .groupBy(*PAGE)
        .agg(F.expr("percentile(s.size, 0.5, s.chars)").alias("body_size"))
    )


def font_profile(spans: DataFrame, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(per block the ``most`` faces by characters, per page all faces by characters)."""
    n = F.sum(F.length("text")).alias("chars")
    size = F.bround("size", 1).alias("size")
    by_block = spans.groupBy(*PAGE, "block_no", "font", size).agg(n)
    rank = Window.partitionBy(*PAGE, "block_no").orderBy(F.desc("chars"), "font", "size")
    top = by_block.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= most)
    by_page = by_block.groupBy(*PAGE, "font", "size").agg(F.sum("chars").alias("chars"))
    return top, by_page
