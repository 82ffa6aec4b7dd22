"""Artifacts: figures, tables and equations with captions and crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators.layout import greedy

# fixed values
KINDS = ("figure", "table", "equation")
PADDING, MIN_SIDE, CAPTION_OVERLAP = 6.0, 24.0, 0.5
DPI = 200


def page_image_path(paper_id: Column, page: Column) -> Column:
    return F.format_string("%s/pages/page_%04d.png", paper_id, page)


def page_images(pages: DataFrame, dpi: int = DPI) -> DataFrame:
    """The page table: what a renderer would write at ``dpi``."""
    if dpi <= 0:
        raise ValueError("dpi must be positive")
    px = lambda c: F.bround(F.col(c) * dpi / 72.0, 0).cast("int")
    return pages.select(
        "paper_id",
        F.col("page").alias("page_index"),
        page_image_path(F.col("paper_id"), F.col("page")).alias("image_path"),
        px("width").alias("width_px"),
        px("height").alias("height_px"),
        F.lit(dpi).alias("dpi"),
    )


def pair_captions(regions: DataFrame) -> DataFrame:
    """(paper_id, artifact_region, caption): nearest pairs of a page first, each region once.
    Ties go by the regions' ids as strings; there is no limit to the distance."""
    b = lambda p: G.field_box(F.col(f"{p}_bbox"))
    side = lambda cond, p: regions.filter(cond).select(
        "paper_id", F.col("bbox.page").alias("page"), *[F.col(c).alias(f"{p}_{c}") for c in ("region_id", "bbox", "text")]
    )
    a = side(F.col("region_type").isin(*KINDS), "a").drop("a_text")
    c = side(F.col("region_type") == "caption", "c")
    pairs = a.join(c, ["paper_id", "page"]).filter(G.x_overlap_ratio(b("a"), b("c")) >= CAPTION_OVERLAP)
    one = F.struct(G.gap(b("a"), b("c")).alias("gap"), F.col("a_region_id").alias("a"), F.col("c_region_id").alias("c"), F.col("c_text").alias("text"))
    chosen = pairs.groupBy("paper_id", "page").agg(greedy(F.array_sort(F.collect_list(one)), "a", "c").alias("p"))
    return chosen.select("paper_id", F.explode("p").alias("p")).select(
        "paper_id", F.col("p.a").alias("artifact_region"), X.strip(F.col("p.text")).alias("caption")
    )


def targets(regions: DataFrame) -> DataFrame:
    """Regions that become artifacts, numbered: ``n`` in the paper, ``k`` in their kind."""
    b = G.field_box(F.col("bbox"))
    big = regions.filter(F.col("region_type").isin(*KINDS) & (G.width(b) >= MIN_SIDE) & (G.height(b) >= MIN_SIDE))
    paper = Window.partitionBy("paper_id").orderBy("order_index")
    kind = Window.partitionBy("paper_id", "region_type").orderBy("order_index")
    return big.withColumns({"n": F.row_number().over(paper) - 1, "k": F.row_number().over(kind)})


def crop_boxes(found: DataFrame, regions: DataFrame, images: DataFrame, padding: float = PADDING) -> DataFrame:
    """(paper_id, region_id, x0, y0, x1, y1, px0, py0, px1, py1): each target's padded box in
    points and pixels. An edge moves by the padding, or half way to the nearest region that
    is in its way, and never off the page."""
    t, o = G.field_box(F.col("bbox")), G.field_box(F.col("o_bbox"))
    others = regions.select(
        F.col("paper_id").alias("o_paper"), F.col("bbox.page").alias("o_page"), F.col("region_id").alias("o_id"), F.col("bbox").alias("o_bbox")
    )
    same = (F.col("paper_id") == F.col("o_paper")) & (F.col("bbox.page") == F.col("o_page")) & (F.col("region_id") != F.col("o_id"))
    beside, above = G.shared(t[1], t[3], o[1], o[3]) > 0, G.shared(t[0], t[2], o[0], o[2]) > 0
    left, top = o[2] <= t[0], o[3] <= t[1]
    room = lambda cond, far: F.least(F.lit(padding), F.coalesce(F.min(F.when(cond, far / 2)), F.lit(padding)))
    rooms = (
        found.join(others, same, "left")
        .groupBy("paper_id", "region_id", "bbox")
        .agg(
            room(beside & left, t[0] - o[2]).alias("l"),
            room(beside & ~left & (o[0] >= t[2]), o[0] - t[2]).alias("r"),
            room(above & top, t[1] - o[3]).alias("u"),
            room(above & ~top & (o[1] >= t[3]), o[1] - t[3]).alias("d"),
        )
    )
    pages = images.select("paper_id", F.col("page_index").alias("page"), "width_px", "height_px", G.scale(F.col("dpi")).alias("s"))
    padded = rooms.withColumn("page", F.col("bbox.page")).join(pages, ["paper_id", "page"])
    zero = F.lit(0.0)
    padded = padded.select(
        "paper_id",
        "region_id",
        F.greatest(zero, t[0] - F.col("l")).alias("x0"),
        F.greatest(zero, t[1] - F.col("u")).alias("y0"),
        F.least(F.col("width_px") / F.col("s"), t[2] + F.col("r")).alias("x1"),
        F.least(F.col("height_px") / F.col("s"), t[3] + F.col("d")).alias("y1"),
        "width_px",
        "height_px",
        "s",
    )
    low = lambda c: F.greatest(F.lit(0), (F.col(c) * F.col("s")).cast("int"))
    high = lambda c, most: F.least(F.col(most), F.bround(F.col(c) * F.col("s"), 0).cast("int"))
    return padded.select(
        "paper_id",
        "region_id",
        "x0",
        "y0",
        "x1",
        "y1",
        low("x0").alias("px0"),
        low("y0").alias("py0"),
        high("x1", "width_px").alias("px1"),
        high("y1", "height_px").alias("py1"),
    )


def extract_artifacts(regions: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """The artifact table, without links. Without a page image the path is null."""
    found = targets(regions)
    stem = F.when(F.col("region_type") == "figure", "fig").when(F.col("region_type") == "table", "tbl").otherwise("eq")
    path = F.format_string("%s/artifacts/%s_%02d.png", F.col("paper_id"), stem, F.col("k"))
    captions = pair_captions(regions).withColumnRenamed("artifact_region", "region_id")
    out = found.join(captions, ["paper_id", "region_id"], "left")
    if images is None:
        out = out.withColumn("rendered", F.lit(False))
    else:
        have = images.select("paper_id", F.col("page_index").alias("have_page"), F.lit(True).alias("rendered"))
        out = out.withColumn("have_page", F.col("bbox.page")).join(have, ["paper_id", "have_page"], "left")
    return out.select(
        F.concat_ws("::", "paper_id", F.lit("artifact"), F.col("n").cast("string")).alias("artifact_id"),
        "paper_id",
        F.col("region_type").alias("artifact_type"),
        F.coalesce("caption", F.lit("")).alias("caption"),
        "bbox",
        F.when(F.col("rendered"), path).alias("image_path"),
        F.array().cast("array<string>").alias("linked_chunk_ids"),
    )
