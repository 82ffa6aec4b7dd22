"""Section-aware chunks.

Where a chunk ends depends on what has gathered since the last cut, so cuts are found by a
fold over a paper's regions, which keeps only the cuts' places; the chunks are then slices of
the same array. Folding short chunks into the one before is a matter of islands and needs
no fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

# fixed values
TARGET, RUNT = 1200, 120


def cuts(regions: Column) -> Column:
    """Places where chunks begin, in an array of (kind, section, text, ...) by order.

    Captions stand alone. Other than prose, and blank texts, are passed over. Prose begins a
    chunk where nothing is open, where the section changes, at a heading, and where the
    chunk would exceed the target.
    """
    start = F.struct(
        F.array().cast("array<int>").alias("at"),
        F.lit(0).alias("held"),
        F.lit("").alias("section"),
        F.lit(False).alias("open"),
        F.lit(0).alias("i"),
    )

    def step(s: Column, r: Column) -> Column:
        caption = r["kind"] == "caption"
        prose = r["kind"].isin("heading", "body") & ~X.is_blank(r["text"])
        n = F.length(r["text"])
        cut = ~s["open"] | (r["section"] != s["section"]) | (r["kind"] == "heading") | (s["held"] + n > TARGET)
        begins = caption | (prose & cut)
        return F.struct(
            F.when(begins, F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"]).alias("at"),
            F.when(caption, 0).when(prose, F.when(cut, n).otherwise(s["held"] + n)).otherwise(s["held"]).cast("int").alias("held"),
            F.when(prose & cut, r["section"]).otherwise(s["section"]).alias("section"),
            F.when(caption, False).when(prose, True).otherwise(s["open"]).alias("open"),
            (s["i"] + 1).alias("i"),
        )

    return F.aggregate(regions, start, step)["at"]


def raw_chunks(regions: DataFrame) -> DataFrame:
    """(paper_id, n, standalone, section, section_title_raw, text, page_start, page_end,
    bbox) before short chunks are folded; bbox is null for chunks over several pages."""
    one = F.struct(
        "order_index",
        F.col("region_type").alias("kind"),
        "section",
        "section_title_raw",
        F.coalesce("text", F.lit("")).alias("text"),
        "bbox",
    )
    papers = regions.groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("r"))
    papers = papers.withColumn("cuts", cuts(F.col("r")))
    slices = F.transform(
        "cuts",
        lambda at, k: F.slice("r", at + 1, F.coalesce(F.get("cuts", k + 1), F.size("r")) - at),
    )
    chunks = papers.select("paper_id", F.posexplode(slices).alias("n", "all"))
    first = F.get("all", 0)
    members = F.when(first["kind"] == "caption", F.slice("all", 1, 1)).otherwise(
        F.filter("all", lambda r: r["kind"].isin("heading", "body") & ~X.is_blank(r["text"]))
    )
    chunks = chunks.select("paper_id", "n", (first["kind"] == "caption").alias("standalone"), members.alias("m"))
    field = lambda f: F.transform("m", lambda r: r["bbox"][f])
    low, high = F.array_min(field("page")), F.array_max(field("page"))
    bbox = F.struct(
        low.alias("page"),
        F.array_min(field("x0")).alias("x0"),
        F.array_min(field("y0")).alias("y0"),
        F.array_max(field("x1")).alias("x1"),
        F.array_max(field("y1")).alias("y1"),
    )
    texts = F.filter(F.transform("m", lambda r: r["text"]), lambda t: ~X.is_blank(t))
    return chunks.select(
        "paper_id",
        "n",
        "standalone",
        F.get("m", 0)["section"].alias("section"),
        F.get("m", 0)["section_title_raw"].alias("section_title_raw"),
        F.array_join(texts, "\n").alias("text"),
        low.alias("page_start"),
        high.alias("page_end"),
        F.when(low == high, bbox).alias("bbox"),
    )


def fold_runts(chunks: DataFrame) -> DataFrame:
    """Chunks under RUNT characters join the one before them in the same section, unless they
    stand alone. The box stays that of the first if all parts end on its page."""
    order = Window.partitionBy("paper_id").orderBy("n")
    joins = (
        ~F.col("standalone")
        & (F.length("text") < RUNT)
        & F.coalesce(F.lag("section").over(order) == F.col("section"), F.lit(False))
    )
    island = F.sum((~joins).cast("int")).over(order)
    part = F.struct("n", "text", "page_end")
    merged = (
        chunks.withColumn("island", island)
        .groupBy("paper_id", "island")
        .agg(
            F.min_by(F.struct("section", "section_title_raw", "page_start", "bbox", "page_end"), "n").alias("head"),
            F.array_sort(F.collect_list(part)).alias("parts"),
        )
    )
    ends = F.transform("parts", lambda p: p["page_end"])
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    index = (F.row_number().over(Window.partitionBy("paper_id").orderBy("island")) - 1).alias("order_index")
    return merged.select(
        "paper_id",
        "head.section",
        "head.section_title_raw",
        text.alias("text"),
        "head.page_start",
        F.element_at(ends, -1).alias("page_end"),
        F.when(F.size(F.array_distinct(ends)) == 1, F.col("head.bbox")).alias("bbox"),
        index,
    )


def chunk_regions(regions: DataFrame) -> DataFrame:
    """The chunk table of labelled regions, without links."""
    c = fold_runts(raw_chunks(regions))
    return c.select(
        F.concat_ws("::", "paper_id", F.lit("chunk"), F.col("order_index").cast("string")).alias("chunk_id"),
        "paper_id",
        "section",
        "section_title_raw",
        "text",
        "page_start",
        "page_end",
        "bbox",
        "order_index",
        X.token_estimate(F.col("text")).alias("token_count"),
        F.array().cast("array<string>").alias("artifact_ids"),
    )
