"""PDF files by content: the upload guard, ids, and the decoder interface."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire import schema as S
from quire.sources.shared import ship, written

# fixed values
MAGIC = b"%PDF"
PDF_TYPES = ("application/pdf", "application/x-pdf")


def paper_id(filename: Column, content: Column) -> Column:
    """The file's stem and the first twelve digits of its SHA-1."""
    return F.concat_ws("-", F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""), F.substring(F.sha1(content), 1, 12))


def is_pdf(filename: Column, content_type: Column | None = None) -> Column:
    """What an upload must be: of a PDF's type, or so named."""
    named = F.lower(filename).endswith(".pdf")
    return named if content_type is None else named | F.coalesce(content_type.isin(*PDF_TYPES), F.lit(False))


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, source_filename, content, length, readable) of the PDFs under ``path``.
    Files without a PDF's first bytes are kept but marked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return files.withColumn("source_filename", name).filter(is_pdf(F.col("source_filename"))).select(
        paper_id(F.col("source_filename"), F.col("content")).alias("paper_id"),
        "source_filename",
        "content",
        "length",
        (F.substring("content", 1, 4) == F.lit(bytearray(MAGIC))).alias("readable"),
    )


class Decoder(Protocol):
    """Reads one PDF; needs a PDF library, which is not part of the engine.

    The result has ``meta_title`` (or None) and, for each of pages, flat, spans, images and
    drawings, a list of dictionaries with the columns of that table in ``quire.schema`` but
    paper_id. Any exception marks the file as one that can't be read.
    """

    def __call__(self, content: bytes) -> dict: ...


TABLES = {"pages": S.PAGE_IR, "flat": S.FLAT_IR, "spans": S.SPAN_IR, "images": S.IMAGE_IR, "drawings": S.DRAWING_IR}


def _decoded_type() -> T.StructType:
    """One row per file: its tables as arrays, without paper_id, or what went wrong."""
    rows = [T.StructField(n, T.ArrayType(T.StructType([f for f in k.fields if f.name != "paper_id"]))) for n, k in TABLES.items()]
    text = [T.StructField(n, T.StringType()) for n in ("paper_id", "source_filename", "error", "meta_title")]
    return T.StructType([*text, T.StructField("content", T.BinaryType()), *rows])


class DecodedFiles:
    """The decoded tables of files (paper_id, source_filename, content), for
    ``pipeline.run_pipeline``, and ``failed`` (paper_id, error): the files that the decoder raises on
    and those that don't begin as a PDF does, which reports count as unreadable.

    Files are decoded one after another in a map, once: the result is written in the shared folder.
    """

    def __init__(self, files: DataFrame, decoder: Decoder):
        ship(files.sparkSession)
        kind = _decoded_type()
        arrow = to_arrow_schema(kind)

        def one(paper_id: str, name: str, content: bytes | None) -> dict:
            out = {"paper_id": paper_id, "source_filename": name, "content": content}
            try:
                if (content or b"")[:4] != MAGIC:
                    raise ValueError("not a PDF")
                made = decoder(content)
                out |= {n: made.get(n) or [] for n in TABLES} | {"meta_title": made.get("meta_title")}
                pa.RecordBatch.from_pylist([out], arrow)  # a row that isn't of the schema is the file's fault
            except Exception as e:  # a broken file must not end the job
                out = {"paper_id": paper_id, "source_filename": name, "error": f"{type(e).__name__}: {e}"[:500]}
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    yield pa.RecordBatch.from_pylist([one(*(x.as_py() for x in row))], arrow)

        made = written(files.select("paper_id", "source_filename", "content").mapInArrow(run, kind), "decoded")
        good = made.filter("error is null")
        self.failed = made.filter("error is not null").select("paper_id", "error")
        self.docs = good.select("paper_id", "source_filename", "content", "meta_title", F.size("pages").alias("page_count"))
        for name, table in TABLES.items():
            rows = good.select("paper_id", F.explode(name).alias("r")).select("paper_id", "r.*")
            setattr(self, name, rows.select(*[f.name for f in table.fields]))


class Decoded:
    """Decoded tables as Parquet under a folder, one folder each; missing ones are empty."""

    TABLES = {"docs": S.DOC_IR, **TABLES}

    def __init__(self, spark: SparkSession, path: str):
        for name, kind in self.TABLES.items():
            setattr(self, name, spark.read.schema(kind).option("ignoreMissingFiles", "true").parquet(f"{path}/{name}"))
