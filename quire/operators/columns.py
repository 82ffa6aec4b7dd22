"""Columns, reading order, and the kinds of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators.blocks import DEFAULT_BODY_SIZE, PAGE
from quire.operators.kernels import MIN_GUTTER_RATIO, ROUGH, STRICT

# fixed values
HEADING_SIZE, MAX_HEADING_CHARS, HEADING_BOLD = 1.12, 120, 0.6
EQUATION_RATIO = 0.5


def coverage(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, page, width, bins, start, end, height): how much block height stands on each
    stretch of a page's width, in whole points.

    A block adds its height where it begins and takes it away behind its end, so it makes
    two rows however wide it is; running sums give the profile between those places.
    """
    width = F.greatest(F.floor("width").cast("int"), F.lit(1))
    b = blocks.join(pages.select(*PAGE, "width", width.alias("bins")), PAGE)
    start = F.greatest(F.col("x0").cast("int"), F.lit(0))
    end = F.least(F.col("x1").cast("int") + 1, F.col("bins"))
    h = F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    place = lambda at, d: F.struct(at.alias("at"), d.alias("d"))
    zero = F.lit(0.0)
    own = F.array(place(F.lit(0), zero), place(start, F.when(start < end, h).otherwise(zero)), place(end, F.when(start < end, -h).otherwise(zero)))
    steps = (
        b.select(*PAGE, "width", "bins", F.explode(own).alias("x"))
        .groupBy(*PAGE, "width", "bins", F.col("x.at").alias("start"))
        .agg(F.sum("x.d").alias("d"))
        .filter("start < bins")
    )
    along = Window.partitionBy(*PAGE).orderBy("start")
    return steps.select(
        *PAGE,
        "width",
        "bins",
        "start",
        F.coalesce(F.lead("start").over(along), F.col("bins")).alias("end"),
        F.round(F.sum("d").over(along), 6).alias("height"),
    )


def low_runs(profile: DataFrame, ratio: float) -> DataFrame:
    """(paper_id, page, start, end) of interior runs at or below ``ratio`` of the peak that are
    wide enough. Stretches follow one another without gaps, so those between two high ones
    are one run."""
    page = Window.partitionBy(*PAGE)
    peak = profile.withColumn("peak", F.max("height").over(page)).filter("peak > 0")
    low = peak.withColumn("low", F.col("height") <= F.col("peak") * ratio)
    runs = low.withColumn("run", F.sum((~F.col("low")).cast("int")).over(page.orderBy("start"))).filter("low")
    return (
        runs.groupBy(*PAGE, "width", "bins", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .filter((F.col("start") > 0) & (F.col("end") < F.col("bins")) & (F.col("end") - F.col("start") >= F.col("width") * MIN_GUTTER_RATIO))
        .select(*PAGE, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    )


def edges(gutters: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, page, edges): borders of the columns between gutters, the page's included."""
    middles = gutters.groupBy(*PAGE).agg(F.array_sort(F.collect_list((F.col("start") + F.col("end")) / 2)).alias("m"))
    none = F.array().cast("array<double>")
    return pages.join(middles, PAGE, "left").select(
        *PAGE, F.concat(F.array(F.lit(0.0)), F.coalesce("m", none), F.array(F.col("width"))).alias("edges")
    )


def gutters(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, page, start, end): found loosely first, then strictly among the blocks
    that stay inside the loosely found columns."""
    rough = low_runs(coverage(blocks, pages), ROUGH)
    within = (
        blocks.join(edges(rough, pages.join(rough.select(*PAGE).distinct(), PAGE, "left_semi")), PAGE)
        .filter(~G.crosses_columns(G.box(), F.col("edges")))
        .drop("edges")
    )
    return low_runs(coverage(within, pages), STRICT)


def reading_order(blocks: DataFrame, page_edges: DataFrame) -> DataFrame:
    """``blocks`` (with ``pos``, a page-wide order for ties) plus column_index and
    order_index, which runs through each paper.

    A block that crosses columns ends a band: what stands above it is read before it, column by
    column. So a band is the number of such blocks so far, and the order is one sort.
    """
    b = blocks.join(page_edges, PAGE)
    many = F.size("edges") > 2
    spans = many & G.crosses_columns(G.box(), F.col("edges"))
    middle = (F.col("x0") + F.col("x1")) / 2.0
    column = F.when(spans | ~many, 0).otherwise(G.column_of(middle, F.col("edges"))).cast("int")
    b = b.withColumns({"spans": spans.cast("int"), "column_index": column}).drop("edges")
    down = Window.partitionBy(*PAGE).orderBy("y0", "pos")
    b = b.withColumn("band", F.sum("spans").over(down))
    paper = Window.partitionBy("paper_id").orderBy("page", "band", F.desc("spans"), "column_index", "y0", "pos")
    return b.withColumn("order_index", F.row_number().over(paper) - 1).drop("band", "spans")


def classify(
    text: Column, font_size: Column, body_size: Column, is_image: Column, math_ratio: Column, bold_ratio: Column, region_kind: Column
) -> Column:
    """A block's kind; the order of the tests matters."""
    short = (F.length(text) <= MAX_HEADING_CHARS) & ~X.is_blank(text)
    larger = F.coalesce(font_size >= F.coalesce(body_size, F.lit(DEFAULT_BODY_SIZE)) * HEADING_SIZE, F.lit(False))
    return (
        F.when(is_image, F.when(region_kind == "table", "table").otherwise("figure"))
        .when(X.is_caption(text), "caption")
        .when(math_ratio >= EQUATION_RATIO, "equation")
        .when(short & (larger | (bold_ratio >= HEADING_BOLD)), "heading")
        .otherwise("body")
    )
