"""Training rows for the classifiers: a bounded sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ship, written


def fold(key: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; null for a null id."""
    return F.crc32(key.cast("string")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled ids for which ``training`` holds,
    written once: those whose hash is least, whatever else the table holds.

    An id labelled more than once counts as 1 if any of its labels is; null labels and
    ids are left out; of an id's texts the one that sorts first is taken, null as empty.
    ``most`` bounds what is broadcast: the sampled ids and labels.
    """
    ship(docs.sparkSession)
    known = (
        labels.filter(training & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return written(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")), "train")
