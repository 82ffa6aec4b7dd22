"""Quality: the scoreboard of two chunkings, and checks of pages and papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X

# fixed values
SHORT, NEAR, MANY, OVERLAP, GIANT = 25, 30.0, 4, 0.5, 0.6
PAGE = ["paper_id", "page"]


def scoreboard(chunks: DataFrame, *by: str) -> DataFrame:
    """Per group: chunks, those of unknown section, those that begin mid-word, and shares."""
    share = lambda c: X.percent(F.col(c), F.col("chunks"))
    return (
        chunks.groupBy(*by)
        .agg(
            F.count("*").alias("chunks"),
            F.count_if(F.col("section") == "unknown").alias("unknown"),
            F.count_if(X.starts_mid_word(F.col("text"))).alias("mid_word"),
        )
        .withColumns({"unknown_share": share("unknown"), "mid_word_share": share("mid_word")})
    )


def page_problems(regions: DataFrame) -> DataFrame:
    """(paper_id, page, problems) of every page: counts behind each check, then messages.

    Counts per page come from one aggregation; the two spatial checks join a page's regions
    with its artifacts only.
    """
    r = regions.select("paper_id", F.col("bbox.page").alias("page"), "region_id", "region_type", "text", "order_index", "bbox")
    b = G.field_box(F.col("bbox"))
    artifact = F.col("region_type").isin("figure", "table")
    count = lambda kind: F.count_if(F.col("region_type") == kind)
    pages = r.groupBy(*PAGE).agg(
        F.max((~X.is_blank(F.col("text"))).cast("int")).alias("has_text"),
        count("caption").alias("captions"),
        (count("figure") + count("table")).alias("artifacts"),
        F.min("bbox.x0").alias("px0"),
        F.min("bbox.y0").alias("py0"),
        F.max("bbox.x1").alias("px1"),
        F.max("bbox.y1").alias("py1"),
    )
    a = r.filter(artifact).select(*[F.col(c).alias(f"a_{c}") for c in (*PAGE, "region_id", "region_type", "order_index", "bbox")])
    ab = G.field_box(F.col("a_bbox"))
    same = (F.col("paper_id") == F.col("a_paper_id")) & (F.col("page") == F.col("a_page"))
    stray = (
        r.filter((F.col("region_type") == "body") & (F.length(X.strip(F.col("text"))) <= SHORT))
        .join(a, same & (G.gap(b, ab) <= NEAR), "left_semi")
        .groupBy(*PAGE)
        .agg(F.count("*").alias("stray"))
    )
    clash = (
        r.filter(artifact)
        .join(a, same & (F.col("order_index") < F.col("a_order_index")) & (F.col("region_type") != F.col("a_region_type")))
        .filter(F.greatest(G.containment(b, ab), G.containment(ab, b)) >= OVERLAP)
        .select(*PAGE)
        .distinct()
        .withColumn("clash", F.lit(True))
    )
    page_area = F.greatest((F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0")), F.lit(1.0))
    giant = (
        r.filter(~artifact)
        .join(pages.select(*PAGE, page_area.alias("page_area")), PAGE)
        .filter(G.area(b) / F.col("page_area") >= GIANT)
        .groupBy(*PAGE)
        .agg(F.min_by("region_type", "order_index").alias("giant"))
    )
    joined = pages.join(stray, PAGE, "left").join(clash, PAGE, "left").join(giant, PAGE, "left")
    says = lambda cond, message: F.when(cond, message)
    messages = F.array(
        says(F.col("has_text") == 0, F.lit("no-text-layer")),
        says(F.col("stray") >= MANY, F.concat(F.col("stray").cast("string"), F.lit(" tiny BODY regions around an artifact"))),
        says(F.col("clash"), F.lit("a TABLE and a FIGURE overlap")),
        says(F.col("giant").isNotNull(), F.concat(F.lit("a "), F.upper("giant"), F.lit(" region covers the page"))),
        says((F.col("captions") > 0) & (F.col("artifacts") == 0), F.lit("a caption with nothing to caption")),
    )
    return joined.select(*PAGE, F.filter(messages, lambda m: m.isNotNull()).alias("problems"))


def paper_report(regions: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Per paper: pages, regions, counts by type, flagged pages with problems. Papers in
    ``unreadable`` (paper_id) count as flagged."""
    kinds = ("heading", "body", "caption", "figure", "table", "equation")
    counts = regions.groupBy("paper_id").agg(
        F.countDistinct("bbox.page").alias("pages"),
        F.count("*").alias("regions"),
        *[F.count_if(F.col("region_type") == k).alias(k) for k in kinds],
    )
    flagged = (
        page_problems(regions)
        .filter(F.size("problems") > 0)
        .groupBy("paper_id")
        .agg(F.count("*").alias("flagged"), F.array_sort(F.collect_list(F.struct("page", "problems"))).alias("problems"))
    )
    out = counts.join(flagged, "paper_id", "left").select(
        "paper_id",
        "pages",
        "regions",
        *kinds,
        F.coalesce("flagged", F.lit(0)).cast("bigint").alias("flagged"),
        (F.col("heading") == 0).alias("no_headings"),
        F.coalesce("problems", F.array().cast("array<struct<page:int,problems:array<string>>>")).alias("problems"),
        F.lit(True).alias("readable"),
    )
    if unreadable is not None:
        lost = unreadable.select("paper_id").join(out.select("paper_id"), "paper_id", "left_anti")
        out = out.unionByName(
            lost.withColumns({"flagged": F.lit(1).cast("bigint"), "readable": F.lit(False)}), allowMissingColumns=True
        )
    return out


def corpus_totals(report: DataFrame) -> DataFrame:
    """One row: papers, flagged papers, and regions by type."""
    kinds = ("heading", "body", "caption", "figure", "table", "equation")
    return report.agg(
        F.count("*").alias("papers"),
        F.count_if(F.col("flagged") > 0).alias("flagged_papers"),
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds],
    )
