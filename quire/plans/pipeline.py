"""From decoded tables to papers, pages, regions, chunks and linked artifacts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import schema as S
from quire.operators import artifacts as A
from quire.operators import baseline, chunking, layout, linking, sections
from quire.sources.shared import written


@dataclass
class Result:
    papers: DataFrame
    pages: DataFrame
    regions: DataFrame
    chunks: DataFrame
    artifacts: DataFrame


def structured(regions: DataFrame, images: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labelled regions, chunks, artifacts), linked both ways. Regions, and what they make,
    are written once, since several steps read them."""
    labelled = written(sections.assign_sections(regions), "regions")
    chunks = written(chunking.chunk_regions(labelled), "chunks")
    found = written(A.extract_artifacts(labelled, images), "artifacts")
    artifacts, chunks = linking.link(found, chunks)
    return labelled, chunks, artifacts


def run_pipeline(decoded, rasterise: bool = True, detect_layout: bool = True, dpi: int = A.DPI) -> Result:
    """``decoded`` has docs, pages, flat, spans, images and drawings (see ``quire.schema``).

    Without layout detection papers keep their baseline chunks and have no regions. A
    paper's title is the file's own, else what its first page shows.
    """
    if not 1 <= dpi <= 600:
        raise ValueError("dpi must be from 1 to 600")
    papers = baseline.papers(decoded.docs)
    images = A.page_images(decoded.pages, dpi)
    spark = papers.sparkSession
    if not rasterise:
        images = images.limit(0)
    if detect_layout:
        regions = layout.extract_regions(decoded.spans, decoded.images, decoded.drawings, decoded.pages)
        regions, chunks, artifacts = structured(regions, images if rasterise else None)
        shown = sections.paper_titles(regions).withColumnRenamed("title", "shown")
        papers = papers.join(shown, "paper_id", "left").withColumn(
            "title", F.coalesce("title", F.when(F.col("shown") != "", F.col("shown")))
        )
    else:
        chunks = baseline.baseline_chunks(decoded.flat)
        regions = spark.createDataFrame([], S.REGIONS)
        artifacts = spark.createDataFrame([], S.ARTIFACTS)
    papers = papers.select(
        "paper_id",
        "source_filename",
        "title",
        "page_count",
        F.lit(S.METHODS[1 if detect_layout else 0]).alias("extraction_method"),
        F.current_timestamp().alias("ingested_at"),
        F.lit(S.SCHEMA_VERSION).alias("schema_version"),
    )
    return Result(papers, images, regions, chunks, artifacts)


def walkthrough(results: DataFrame, docs: DataFrame, flat: DataFrame) -> DataFrame:
    """(paper_id, walkthrough): JSON of each paper's record, its baseline chunks made anew, and
    the size of its source. Without a source the last two are null."""
    fresh = baseline.baseline_chunks(flat)
    one = F.struct("order_index", F.struct("chunk_id", "text", "page_start", "page_end", "token_count").alias("c"))
    base = fresh.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("baseline"))
    size = docs.select("paper_id", F.octet_length("content").alias("source_bytes")).filter("source_bytes is not null")
    whole = F.struct(*[c for c in results.columns if c != "paper_id"]).alias("result")
    return (
        results.select("paper_id", whole)
        .join(size, "paper_id", "left")
        .join(base, "paper_id", "left")
        .withColumn("baseline", F.when(F.col("source_bytes").isNotNull(), F.col("baseline")))
        .select("paper_id", F.to_json(F.struct("result", "baseline", "source_bytes"), {"ignoreNullFields": "false"}).alias("walkthrough"))
    )
