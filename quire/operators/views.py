"""What a viewer shows: tallies, runs, previews and cards, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X

# fixed values
CHUNK_PREVIEW, CHUNK_CHARS = 4, 210
TILE_CHARS, LINK_CHARS, NO_CAPTION = 120, 90, "No caption printed beside it."
ARTIFACT_LIMIT, LINK_PREVIEW, PAGE_LINKS, THUMBNAILS, COMPARE_LIMIT, COMPARE_CHARS = 8, 4, 10, 12, 12, 260


def region_tally(regions: DataFrame) -> DataFrame:
    """(paper_id, region_type, regions)."""
    return regions.groupBy("paper_id", "region_type").agg(F.count("*").alias("regions"))


def busiest_page(regions: DataFrame, images: DataFrame) -> DataFrame:
    """(paper_id, busiest, pages): the rendered page with most regions, the first seen of equals,
    and the first pages to link to."""
    per_page = regions.groupBy("paper_id", F.col("bbox.page").alias("page")).agg(
        F.count("*").alias("n"), F.min("order_index").alias("seen")
    )
    shown = per_page.join(images.select("paper_id", F.col("page_index").alias("page")), ["paper_id", "page"], "left_semi")
    return shown.groupBy("paper_id").agg(
        F.max_by("page", F.struct("n", (-F.col("seen")).alias("s"))).alias("busiest"),
        F.slice(F.array_sort(F.collect_list("page")), 1, PAGE_LINKS).alias("pages"),
    )


def section_run(regions: DataFrame) -> DataFrame:
    """(paper_id, place, section, regions, title): sections as they first appear."""
    titled = F.min_by(F.when(F.col("section_title_raw") != "", F.col("section_title_raw")), F.when(F.col("section_title_raw") != "", F.col("order_index")))
    runs = regions.groupBy("paper_id", "section").agg(
        F.min("order_index").alias("first"), F.count("*").alias("regions"), titled.alias("title")
    )
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("first")) - 1
    return runs.select("paper_id", place.alias("place"), "section", "regions", F.coalesce("title", F.lit("")).alias("title"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(paper_id, chunks, placed, tokens)."""
    return chunks.groupBy("paper_id").agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("section") != "unknown").alias("placed"),
        F.sum("token_count").alias("tokens"),
    )


def chunk_preview(chunks: DataFrame, n: int = CHUNK_PREVIEW) -> DataFrame:
    """(paper_id, order_index, section, chars, page, head, body) of each paper's first chunks.
    A chunk of several lines shows the first as its head."""
    first = chunks.filter(F.col("order_index") < n)
    head = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(head) + 2, F.length("text"))
    cut = lambda t: F.concat(F.substring(X.flat(t), 1, CHUNK_CHARS), F.when(F.length(t) > CHUNK_CHARS, " …").otherwise(""))
    return first.select(
        "paper_id",
        "order_index",
        "section",
        F.length("text").alias("chars"),
        (F.col("page_start") + 1).alias("page"),
        F.when(rest != "", head).otherwise("").alias("head"),
        F.when(rest != "", cut(rest)).otherwise(cut(head)).alias("body"),
    )


def artifact_summary(artifacts: DataFrame) -> DataFrame:
    """(paper_id, artifact_type, artifacts, cropped)."""
    return artifacts.groupBy("paper_id", "artifact_type").agg(
        F.count("*").alias("artifacts"), F.count("image_path").alias("cropped")
    )


def artifact_tiles(artifacts: DataFrame, n: int = ARTIFACT_LIMIT) -> DataFrame:
    """(paper_id, place, artifact_type, page, caption, image_path) of each paper's first artifacts. A
    missing caption is said to be missing; a path is null where nothing was cropped."""
    place = F.substring_index("artifact_id", "::", -1).cast("int")
    return artifacts.withColumn("place", place).filter(F.col("place") < n).select(
        "paper_id",
        "place",
        "artifact_type",
        (F.col("bbox.page") + 1).alias("page"),
        F.when(F.col("caption") == "", NO_CAPTION).otherwise(F.substring("caption", 1, TILE_CHARS)).alias("caption"),
        "image_path",
    )


def link_stats(artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, artifacts, linked, unlinked, mentions, citing)."""
    a = artifacts.groupBy("paper_id").agg(
        F.count("*").alias("artifacts"),
        F.count_if(F.size("linked_chunk_ids") > 0).alias("linked"),
        F.sum(F.size("linked_chunk_ids")).alias("mentions"),
    )
    c = chunks.groupBy("paper_id").agg(F.count_if(F.size("artifact_ids") > 0).alias("citing"))
    return a.join(c, "paper_id", "left").select(
        "paper_id",
        "artifacts",
        "linked",
        (F.col("artifacts") - F.col("linked")).alias("unlinked"),
        "mentions",
        F.coalesce("citing", F.lit(0)).alias("citing"),
    )


def keyword_in_context(artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, artifact_id, chunk_id, before, marked, after) for each artifact's first link."""
    first = artifacts.filter(F.size("linked_chunk_ids") > 0).select(
        "paper_id", "artifact_id", X.caption_label(F.col("caption")).alias("label"), F.get("linked_chunk_ids", 0).alias("chunk_id")
    )
    return first.join(chunks.select("paper_id", "chunk_id", "text"), ["paper_id", "chunk_id"]).select(
        "paper_id", "artifact_id", "chunk_id", X.snippet(F.col("text"), F.col("label")).alias("s")
    ).select("paper_id", "artifact_id", "chunk_id", "s.*")


def link_previews(artifacts: DataFrame, chunks: DataFrame, n: int = LINK_PREVIEW) -> DataFrame:
    """(paper_id, place, artifact_type, page, caption, chunk, section, before, marked, after): of each paper's
    first linked artifacts the first passage that names them, around the mention."""
    number = F.substring_index("artifact_id", "::", -1).cast("int")
    linked = Window.partitionBy("paper_id").orderBy(number)
    first = (
        artifacts.filter(F.size("linked_chunk_ids") > 0)
        .withColumn("place", F.row_number().over(linked) - 1)
        .filter(F.col("place") < n)
        .select(
            "paper_id", "place", "artifact_type", (F.col("bbox.page") + 1).alias("page"), F.substring("caption", 1, LINK_CHARS).alias("caption"),
            X.caption_label(F.col("caption")).alias("label"), F.get("linked_chunk_ids", 0).alias("chunk_id"),
        )
    )
    named = chunks.select("paper_id", "chunk_id", "text", F.col("order_index").alias("chunk"), F.replace("section", F.lit("_"), F.lit(" ")).alias("section"))
    return first.join(named, ["paper_id", "chunk_id"]).withColumn("s", X.snippet(F.col("text"), F.col("label"))).select(
        "paper_id", "place", "artifact_type", "page", "caption", "chunk", "section", "s.*"
    )


def headline(regions: DataFrame, chunks: DataFrame, artifacts: DataFrame, baseline: DataFrame) -> DataFrame:
    """(paper_id, regions, sections, chunks, placed, artifacts, mid-word shares of both runs)."""
    mid = lambda df, name: df.groupBy("paper_id").agg(
        X.percent(F.count_if(X.starts_mid_word(F.col("text"))), F.count("*")).alias(name)
    )
    r = regions.groupBy("paper_id").agg(
        F.count("*").alias("regions"),
        F.count_distinct(F.when(F.col("section") != "unknown", F.col("section"))).alias("sections"),
    )
    a = artifacts.groupBy("paper_id").agg(F.count("*").alias("artifacts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        r.join(chunk_stats(chunks), "paper_id", "left")
        .join(a, "paper_id", "left")
        .join(mid(baseline, "baseline_mid_word"), "paper_id", "left")
        .join(mid(chunks, "layout_mid_word"), "paper_id", "left")
        .select(
            "paper_id", "regions", "sections", zero("chunks"), zero("placed"), zero("artifacts"),
            F.coalesce("baseline_mid_word", F.lit("—")).alias("baseline_mid_word"),
            F.coalesce("layout_mid_word", F.lit("—")).alias("layout_mid_word"),
        )
    )


def exemplars(baseline: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, broken, whole): the first baseline chunk that begins mid-word, and the first
    chunk of several lines with a section."""
    broken = baseline.filter(X.starts_mid_word(F.col("text"))).groupBy("paper_id").agg(F.min_by("text", "order_index").alias("broken"))
    whole = chunks.filter((F.col("section") != "unknown") & F.col("text").contains("\n")).groupBy("paper_id").agg(F.min_by("text", "order_index").alias("whole"))
    return broken.join(whole, "paper_id", "full")


def comparison(baseline: DataFrame, chunks: DataFrame, n: int = COMPARE_LIMIT) -> DataFrame:
    """(paper_id, run, order_index, section, chars, page, shown): the first chunks of both runs."""
    side = lambda df, run: df.filter(F.col("order_index") < n).select(
        "paper_id", F.lit(run).alias("run"), "order_index", "section", F.length("text").alias("chars"),
        F.col("page_start").alias("page"), X.clip(F.col("text"), COMPARE_CHARS).alias("shown"),
    )
    return side(baseline, "baseline").unionByName(side(chunks, "layout"))


def overlay(regions: DataFrame, images: DataFrame) -> DataFrame:
    """(paper_id, page, badge, region_type, px0, py0, px1, py1): boxes to draw, numbered on each page
    from 1 in reading order."""
    s = G.scale(F.col("dpi"))
    px = lambda c: F.round(F.col(f"bbox.{c}") * s, 3).alias(f"p{c}")
    i = images.select("paper_id", F.col("page_index").alias("page"), "dpi")
    on_page = Window.partitionBy("paper_id", "page").orderBy("order_index")
    placed = regions.withColumn("page", F.col("bbox.page")).withColumn("badge", F.row_number().over(on_page))
    return placed.join(i, ["paper_id", "page"]).select("paper_id", "page", "badge", "region_type", *[px(c) for c in ("x0", "y0", "x1", "y1")])


def overlay_legend(regions: DataFrame) -> DataFrame:
    """(paper_id, page, region_type, regions): what an overlay's legend counts, kinds that a page lacks left out."""
    return regions.groupBy("paper_id", F.col("bbox.page").alias("page"), "region_type").agg(F.count("*").alias("regions"))


def gallery(images: DataFrame) -> DataFrame:
    """(paper_id, page, href): a card per page; ids are percent-encoded."""
    ident = F.replace(F.url_encode("paper_id"), F.lit("+"), F.lit("%20"))
    return images.select(
        "paper_id",
        F.col("page_index").alias("page"),
        F.concat(F.lit("/paper/"), ident, F.lit("/page/"), F.col("page_index").cast("string")).alias("href"),
    )


def page_strip(images: DataFrame, n: int = THUMBNAILS) -> DataFrame:
    """(paper_id, pages, shown): page count and the first pages' image paths."""
    return images.groupBy("paper_id").agg(
        F.count("*").alias("pages"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "image_path"))), lambda x: x["image_path"]), 1, n).alias("shown"),
    )


def paper_cards(papers: DataFrame, pages: DataFrame, chunks: DataFrame, artifacts: DataFrame, corrupt: DataFrame | None = None) -> DataFrame:
    """(paper_id, title, pages, chunks, artifacts, damaged): a card per record, damaged ones too."""
    n = lambda df, name: df.groupBy("paper_id").agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    cards = (
        papers.join(n(pages, "pages"), "paper_id", "left")
        .join(n(chunks, "chunks"), "paper_id", "left")
        .join(n(artifacts, "artifacts"), "paper_id", "left")
        .select("paper_id", "title", zero("pages"), zero("chunks"), zero("artifacts"), F.lit(False).alias("damaged"))
    )
    if corrupt is None:
        return cards
    return cards.unionByName(corrupt.select("paper_id").withColumn("damaged", F.lit(True)), allowMissingColumns=True)


def file_rows(papers: DataFrame) -> DataFrame:
    """(paper_id, source_filename, size): a file's name and readable size."""
    return papers.select("paper_id", "source_filename", X.human_size(F.col("source_bytes")).alias("size"))


def page_lookup(images: DataFrame, paper_id: str, page: int) -> DataFrame:
    """(status, image_path) of one page's image: 200, or 404 if there is none."""
    found = images.filter((F.col("paper_id") == paper_id) & (F.col("page_index") == page)).select("image_path")
    return _looked_up(found)


def overlay_lookup(regions: DataFrame, images: DataFrame, paper_id: str, page: int) -> DataFrame:
    """(status, image_path) of the page that an overlay is drawn on: 200, or 404 without an image or a region."""
    on_page = (F.col("paper_id") == paper_id) & (F.col("bbox.page") == page)
    found = images.filter((F.col("paper_id") == paper_id) & (F.col("page_index") == page)).select("paper_id", "image_path")
    return _looked_up(found.join(regions.filter(on_page).select("paper_id"), "paper_id", "left_semi").select("image_path"))


def artifact_lookup(artifacts: DataFrame, paper_id: str, place: int) -> DataFrame:
    """(status, image_path) of the artifact at a place in its paper's list: 200, or 404 if the
    place is past the end or the artifact wasn't cropped."""
    wanted = F.concat_ws("::", F.lit(paper_id), F.lit("artifact"), F.lit(str(place)))
    found = artifacts.filter((F.col("paper_id") == paper_id) & (F.col("artifact_id") == wanted)).select("image_path")
    return _looked_up(found)


def _looked_up(found: DataFrame) -> DataFrame:
    path = F.max("image_path")
    return found.agg(F.when(path.isNotNull(), 200).otherwise(404).alias("status"), path.alias("image_path"))
