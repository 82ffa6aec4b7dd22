"""Atom feeds of papers: id, title and the link to the PDF, and the PDFs themselves."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.sources.files import MAGIC
from quire.sources.shared import ship

#: Seconds between two requests.
DELAY = 3.0

ENTRY = "id string, title string, link array<struct<_href:string,_title:string,_type:string,_rel:string>>"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(paper, title, pdf_url, filename): entries with an id and a link titled pdf. Titles are
    unwrapped; the id is what follows the last slash."""
    entries = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)
    ident = F.substring_index(F.trim("id"), "/", -1)
    pdf = F.get(F.filter("link", lambda x: x["_title"] == "pdf"), 0)["_href"]
    found = entries.select(ident.alias("paper"), X.flat(F.coalesce("title", F.lit(""))).alias("title"), pdf.alias("pdf_url"))
    return found.filter("paper <> '' and pdf_url is not null").withColumn(
        "filename", X.safe_name(F.col("paper"), F.col("title"))
    )


def fetch(found: DataFrame, have: DataFrame, get: Callable[[str], bytes], delay: float = DELAY) -> DataFrame:
    """(paper, filename, content, error) of the papers of ``read_feed`` whose filename isn't in ``have``.

    ``get`` reads a URL. One task asks for one after another, as a feed's owner expects; a request that
    fails, or whose answer is no PDF, has an error and no content, and the rest go on. Read the
    result once, or write it first: reading it asks again.
    """
    ship(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            for paper, url, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun:
                    time.sleep(delay)
                begun = True
                content = error = None
                try:
                    content = get(url)
                    if content[:4] != MAGIC:
                        content, error = None, "not a PDF"
                except Exception as e:  # one bad paper must not stop the run
                    error = f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([paper]), pa.array([name]), pa.array([content], pa.binary()), pa.array([error], pa.string())],
                    names=["paper", "filename", "content", "error"],
                )

    wanted = found.join(have.select("filename"), "filename", "left_anti").select("paper", "pdf_url", "filename")
    return wanted.coalesce(1).mapInArrow(run, "paper string, filename string, content binary, error string")
