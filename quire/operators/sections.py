"""Sections carried forward from headings, and a paper's title from its front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

# fixed values
MAX_TITLE_CHARS, SAME_TYPE, MAX_LINE_GAP = 200, 0.6, 2.0


def assign_sections(regions: DataFrame) -> DataFrame:
    """``regions`` with section and section_title_raw filled in.

    A heading of a known section opens it, itself included; others change nothing; what
    comes before the first is the title.
    """
    found = F.when(F.col("region_type") == "heading", X.classify_section(F.col("text")))
    known = F.when(F.col("found") != "unknown", F.struct(F.col("found").alias("section"), X.strip(F.col("text")).alias("raw")))
    upto = Window.partitionBy("paper_id").orderBy("order_index").rowsBetween(Window.unboundedPreceding, 0)
    opened = regions.withColumn("found", found).withColumn("opened", F.last(known, ignorenulls=True).over(upto))
    return opened.withColumns(
        {
            "section": F.coalesce("opened.section", F.lit("title")),
            "section_title_raw": F.coalesce("opened.raw", F.lit("")),
        }
    ).drop("opened", "found")


def is_sideways(bbox: Column) -> Column:
    w, h = bbox["x1"] - bbox["x0"], bbox["y1"] - bbox["y0"]
    return (w > 0) & (h > w)


def is_shouted(text: Column) -> Column:
    """In capitals, with four letters at least."""
    t = X.flat(text)
    return (F.length(F.regexp_replace(t, r"(?U)\P{Alpha}", "")) >= 4) & (t == F.upper(t))


def join_lines(lines: Column) -> Column:
    """The first run of accepted lines as one string.

    lines: array of (ok, text, size, top, bottom), text flattened. A run ends where a line
    isn't accepted or is blank, where the type or the distance changes, and where the whole
    would be too long; lines too long to begin a title are passed over.
    """
    start = F.struct(
        F.lit("").alias("text"),
        F.lit(None).cast("double").alias("size"),
        F.lit(0.0).alias("bottom"),
        F.lit(False).alias("done"),
    )

    def step(s: Column, x: Column) -> Column:
        begun = s["text"] != ""
        fits = x["ok"] & (x["text"] != "")
        longer = F.concat(s["text"], F.lit(" "), x["text"])
        goes_on = (
            fits
            & s["size"].isNotNull()
            & x["size"].isNotNull()
            & (F.abs(x["size"] - s["size"]) <= SAME_TYPE)
            & (x["top"] - s["bottom"] <= MAX_LINE_GAP * s["size"])
            & (F.length(longer) <= MAX_TITLE_CHARS)
        )
        goes_on = F.coalesce(goes_on, F.lit(False))
        opens = fits & (F.length(x["text"]) <= MAX_TITLE_CHARS)
        make = lambda text, size, bottom, done: F.struct(
            text.alias("text"), size.cast("double").alias("size"), bottom.cast("double").alias("bottom"), done.alias("done")
        )
        return (
            F.when(s["done"], s)
            .when(~begun, F.when(opens, make(x["text"], x["size"], x["bottom"], F.lit(False))).otherwise(s))
            .when(goes_on, make(longer, s["size"], x["bottom"], F.lit(False)))
            .otherwise(make(s["text"], s["size"], s["bottom"], F.lit(True)))
        )

    return F.aggregate(lines, start, step)["text"]


def paper_titles(regions: DataFrame) -> DataFrame:
    """(paper_id, title): the first heading block before any recognised section, else the
    first block in capitals; empty if there is neither."""
    upto = Window.partitionBy("paper_id").orderBy("order_index").rowsBetween(Window.unboundedPreceding, 0)
    front = (
        regions.withColumn("left", F.max((F.col("section") != "title").cast("int")).over(upto))
        .filter((F.col("left") == 0) & ~is_sideways(F.col("bbox")))
        .groupBy("paper_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "order_index",
                        (F.col("region_type") == "heading").alias("heading"),
                        is_shouted(F.col("text")).alias("shouted"),
                        X.flat(F.col("text")).alias("text"),
                        F.col("font_size").alias("size"),
                        F.col("bbox.y0").alias("top"),
                        F.col("bbox.y1").alias("bottom"),
                    )
                )
            ).alias("lines")
        )
    )

    def lines(test: str) -> Column:
        return F.transform(
            "lines",
            lambda x: F.struct(
                x[test].alias("ok"), x["text"].alias("text"), x["size"].alias("size"), x["top"].alias("top"), x["bottom"].alias("bottom")
            ),
        )

    title = F.when(F.exists("lines", lambda x: x["heading"]), join_lines(lines("heading"))).otherwise(join_lines(lines("shouted")))
    everyone = regions.select("paper_id").distinct()
    return everyone.join(front.select("paper_id", title.alias("title")), "paper_id", "left").select(
        "paper_id", F.coalesce("title", F.lit("")).alias("title")
    )
