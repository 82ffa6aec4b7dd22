"""The record store: one JSON record per paper, and the papers' files.

A save appends files sorted by paper, through Spark's committer; it reads and rewrites
nothing that is stored. Of a paper's records the newest counts. A reader during a save may
see some of its papers and not yet others, but each with a whole record, its old one or
its new one. ``compact`` writes the newest records as a generation of their own,
which readers turn to once Spark has marked it whole. Records that can't be read stay, marked.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from quire import schema as S

#: Papers with more than one stored version are sought by a broadcast of up to so many.
BROADCAST_PAPERS = 200_000


def results(
    papers: DataFrame, pages: DataFrame, regions: DataFrame, chunks: DataFrame, artifacts: DataFrame
) -> DataFrame:
    """One nested row per paper from the tables."""

    def nested(df: DataFrame, order: str, name: str, drop_paper: bool = False) -> DataFrame:
        cols = [c for c in df.columns if not (drop_paper and c == "paper_id")]
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.struct(*cols).alias("v"))))
        return df.groupBy("paper_id").agg(F.transform(rows, lambda x: x["v"]).alias(name))

    number = F.substring_index("artifact_id", "::", -1).cast("int")
    arts = artifacts.withColumn("n", number)
    parts = {
        "chunks": nested(chunks, "order_index", "chunks"),
        "artifacts": nested(arts, "n", "artifacts").withColumn(
            "artifacts", F.transform("artifacts", lambda a: a.dropFields("n"))
        ),
        "pages": nested(pages, "page_index", "pages", True),
        "regions": nested(regions, "order_index", "regions"),
    }
    kind = S.result_type()
    paper = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind["paper"].dataType.fields]).alias("paper")
    out = papers.select("paper_id", F.coalesce("schema_version", F.lit(S.SCHEMA_VERSION)).alias("schema_version"), paper)
    for name, df in parts.items():
        out = out.join(df, "paper_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kind[name].dataType)))
    return out.select("paper_id", *[f.name for f in kind.fields])


def to_records(found: DataFrame) -> DataFrame:
    """(paper_id, record): each row of ``results`` as JSON."""
    return found.select("paper_id", F.to_json(F.struct(*[c for c in found.columns if c != "paper_id"]), {"ignoreNullFields": "false"}).alias("record"))


# ---- versions by paper ----------------------------------------------------------------


def _stored_type(value: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("paper_id", T.StringType()), value, T.StructField("saved", T.LongType()), T.StructField("serial", T.LongType())])


_RECORD = _stored_type(T.StructField("record", T.StringType()))
_SOURCE = _stored_type(T.StructField("content", T.BinaryType()))


def _generation(spark: SparkSession, path: str) -> int:
    """The newest generation that Spark has marked whole; 0, which saves begin, needs no mark."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    numbers = sorted((int(m[1]) for n in names if (m := re.fullmatch(r"generation-(\d+)", n))), reverse=True)
    whole = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/generation-{n}/_SUCCESS"))
    return next((n for n in numbers if whole(n)), 0)


def _stored(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """Every stored version."""
    try:
        return spark.read.schema(kind).parquet(f"{path}/generation-{_generation(spark, path)}")
    except AnalysisException:
        return spark.createDataFrame([], kind)


def _append(rows: DataFrame, path: str, generation: int) -> None:
    """Files sorted by paper, with Bloom filters on it, so that a lookup reads little of them."""
    (
        rows.sortWithinPartitions("paper_id")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#paper_id", "true")
        .parquet(f"{path}/generation-{generation}")
    )


def _newest(stored: DataFrame) -> DataFrame:
    """The newest version of each paper. Only papers with several enter a join by more than
    their id and version."""
    version = F.struct("saved", "serial")
    several = (
        stored.groupBy(F.col("paper_id").alias("again")).agg(F.max(version).alias("newest"), F.count("*").alias("n")).filter("n > 1").select("again", "newest")
    )
    several = F.broadcast(several) if several.count() <= BROADCAST_PAPERS else several
    return (
        stored.join(several, F.col("paper_id").eqNullSafe(F.col("again")), "left")
        .filter(F.col("newest").isNull() | (version == F.col("newest")))
        .drop("again", "newest", "saved", "serial")
    )


def _save(rows: DataFrame, path: str, column: str) -> None:
    made = rows.select("paper_id", column, F.lit(time.time_ns()).alias("saved"), F.monotonically_increasing_id().alias("serial"))
    _append(made, path, _generation(rows.sparkSession, path))


# ---- records --------------------------------------------------------------------------


def save(records: DataFrame, path: str) -> None:
    """Adds or replaces the records (paper_id, record) of the papers in ``records``."""
    _save(records, path, "record")


def compact(spark: SparkSession, path: str, kind: T.StructType = _RECORD) -> None:
    """The newest version of each paper as a new generation, sorted by paper; what was saved
    before stays until its owner removes it. Not while something is being saved."""
    now = _generation(spark, path)
    stored = _stored(spark, path, kind)
    kept = stored.withColumn("k", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("saved"), F.desc("serial"))))
    _append(kept.filter("k = 1").drop("k").repartitionByRange("paper_id"), path, now + 1)


def _parsed(rows: DataFrame) -> DataFrame:
    kind = S.result_type()
    marked = T.StructType([*kind.fields, T.StructField("broken", T.StringType())])
    parsed = F.from_json("record", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = rows.withColumn("r", parsed)
    corrupt = F.col("r").isNull() | F.col("r.broken").isNotNull() | F.col("r.paper").isNull()
    whole = F.struct(*[F.col(f"r.{f.name}") for f in kind.fields])
    return rows.select("paper_id", corrupt.alias("corrupt"), F.when(~corrupt, whole).alias("result"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, corrupt, result): every record, parsed; an empty or broken one is marked
    and has a null result."""
    return _parsed(_newest(_stored(spark, path, _RECORD)))


def paper_ids(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, _RECORD).select("paper_id").distinct().orderBy("paper_id")


def _one(stored: DataFrame, ident: str) -> DataFrame:
    return stored.filter(F.col("paper_id") == ident).orderBy(F.desc("saved"), F.desc("serial")).limit(1)


def lookup(spark: SparkSession, path: str, ident: str) -> DataFrame:
    """(paper_id, status, result) of one paper: 200, 404 for none, 500 for a corrupt record. The
    paper is sought in the files, before anything is parsed."""
    found = _parsed(_one(_stored(spark, path, _RECORD), ident))
    status = F.when(F.col("corrupt"), 500).otherwise(200)
    asked = spark.range(1).select(F.lit(ident).alias("paper_id"))
    return asked.join(found, "paper_id", "left").select(
        "paper_id", F.when(F.col("corrupt").isNull(), 404).otherwise(status).alias("status"), "result"
    )


# ---- kept files -----------------------------------------------------------------------


def save_sources(files: DataFrame, path: str) -> None:
    """Keeps the files (paper_id, content) of papers, so that a stage can run again on them."""
    _save(files, path, "content")


def sources(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, content): every paper's file, the newest that was kept."""
    return _newest(_stored(spark, path, _SOURCE))


def source(spark: SparkSession, path: str, ident: str) -> DataFrame:
    """(paper_id, content) of one paper's file; no row if none was kept."""
    return _one(_stored(spark, path, _SOURCE), ident).select("paper_id", "content")


def comparison_status(spark: SparkSession, path: str, kept: str, ident: str) -> DataFrame:
    """(paper_id, status): whether a paper's runs can be compared: 404 and 500 as in ``lookup``,
    409 if its file was not kept, else 200."""
    record, file = lookup(spark, path, ident), source(spark, kept, ident).select(F.col("paper_id").alias("kept_id"))
    there = F.col("kept_id").isNotNull()
    return record.join(file, F.col("paper_id") == F.col("kept_id"), "left").select(
        "paper_id", F.when((F.col("status") == 200) & ~there, 409).otherwise(F.col("status")).alias("status")
    )
