"""The flat baseline: fixed windows over a document's text, blind to its structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

# fixed values
SIZE, OVERLAP = 800, 100


def window_texts(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The windows of a text, blank ones left out."""
    step = max(size - overlap, 1)
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))
    return F.filter(windows, lambda w: ~X.is_blank(w))


def windows(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, order_index, raw): one row per window, by one generator in the scan's stage."""
    return docs.select(key, F.posexplode(window_texts(F.col(text), size, overlap)).alias("order_index", "raw"))


def document_text(flat: DataFrame) -> DataFrame:
    """(paper_id, text, starts): pages joined without a separator, and where each begins.

    flat: (paper_id, page, text). A paper's pages meet in one row, as its windows need.
    """
    pages = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    joined = flat.groupBy("paper_id").agg(pages.alias("pages"))
    begins = F.aggregate(
        "pages",
        F.array().cast("array<struct<start:int,page:int>>"),
        lambda acc, p: F.concat(
            acc,
            F.array(
                F.struct(
                    F.coalesce(F.get(acc, F.size(acc) - 1)["start"] + F.length(F.get(F.col("pages"), F.size(acc) - 1)["text"]), F.lit(0))
                    .cast("int")
                    .alias("start"),
                    p["page"].cast("int").alias("page"),
                )
            ),
        ),
    )
    return joined.select("paper_id", F.array_join(F.transform("pages", lambda p: p["text"]), "").alias("text"), begins.alias("starts"))


def page_at(starts: Column, offset: Column) -> Column:
    """The last page that begins at or before ``offset``; 0 if there is none."""
    return F.coalesce(F.element_at(F.filter(starts, lambda s: s["start"] <= offset), -1)["page"], F.lit(0))


def baseline_chunks(flat: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of every paper in the shape of the chunk table, all of unknown section.

    A window's offset is its place among the windows kept times the step, so pages drift
    after a blank window; that is the defined behaviour.
    """
    step = max(size - overlap, 1)
    docs = document_text(flat)
    cut = docs.select(
        "paper_id", "starts", F.posexplode(window_texts(F.col("text"), size, overlap)).alias("order_index", "raw")
    )
    start = F.col("order_index") * step
    end = F.greatest(start + F.length("raw") - 1, start)
    return cut.select(
        F.concat_ws("::", "paper_id", F.lit("chunk"), F.col("order_index").cast("string")).alias("chunk_id"),
        "paper_id",
        F.lit("unknown").alias("section"),
        F.lit("").alias("section_title_raw"),
        X.strip(F.col("raw")).alias("text"),
        page_at(F.col("starts"), start).alias("page_start"),
        page_at(F.col("starts"), end).alias("page_end"),
        F.lit(None).cast("struct<page:int,x0:double,y0:double,x1:double,y1:double>").alias("bbox"),
        "order_index",
        X.word_count(F.col("raw")).alias("token_count"),
        F.array().cast("array<string>").alias("artifact_ids"),
    )


def page_boundaries(flat: DataFrame) -> DataFrame:
    """(paper_id, page, start): where each page's text begins in its document."""
    order = Window.partitionBy("paper_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return flat.select(
        "paper_id",
        "page",
        F.coalesce(F.sum(F.length(F.coalesce("text", F.lit("")))).over(order), F.lit(0)).alias("start"),
    )


def papers(docs: DataFrame) -> DataFrame:
    """(paper_id, source_filename, title, page_count, source_bytes) of decoded documents."""
    return docs.select(
        "paper_id",
        "source_filename",
        X.clean_title(F.col("meta_title"), F.col("source_filename")).alias("title"),
        "page_count",
        F.octet_length("content").alias("source_bytes"),
    )
