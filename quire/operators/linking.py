"""Links between artifacts and the chunks that cite them: an equi-join on labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X


def _n(ident: Column) -> Column:
    """An id's number, the part after its last ``::``."""
    return F.substring_index(ident, "::", -1).cast("int")


def artifact_labels(artifacts: DataFrame) -> DataFrame:
    """(paper_id, artifact_id, kind, num) of the artifacts whose caption opens with a label."""
    return (
        artifacts.select("paper_id", "artifact_id", X.caption_label(F.col("caption")).alias("l"))
        .filter("l is not null")
        .select("paper_id", "artifact_id", "l.kind", "l.num")
    )


def chunk_references(chunks: DataFrame) -> DataFrame:
    """(paper_id, chunk_id, kind, num): each label that a chunk names, once."""
    return chunks.select("paper_id", "chunk_id", F.explode(X.references(F.col("text"))).alias("l")).select(
        "paper_id", "chunk_id", "l.kind", "l.num"
    )


def links(artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(paper_id, artifact_id, chunk_id) edges."""
    return artifact_labels(artifacts).join(chunk_references(chunks), ["paper_id", "kind", "num"]).select(
        "paper_id", "artifact_id", "chunk_id"
    )


def link(artifacts: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifacts, chunks) with their links filled in, in reading order; those without keep
    an empty list."""
    edges = links(artifacts, chunks)

    def gathered(key: str, other: str, name: str) -> DataFrame:
        one = F.struct(_n(F.col(other)).alias("n"), F.col(other).alias("id"))
        return edges.groupBy("paper_id", key).agg(
            F.transform(F.array_sort(F.collect_list(one)), lambda x: x["id"]).alias(name)
        )

    def filled(table: DataFrame, key: str, other: str, name: str) -> DataFrame:
        found = gathered(key, other, "found")
        return (
            table.join(found, ["paper_id", key], "left")
            .withColumn(name, F.coalesce("found", F.array().cast("array<string>")))
            .select(*table.columns)
        )

    return (
        filled(artifacts, "artifact_id", "chunk_id", "linked_chunk_ids"),
        filled(chunks, "chunk_id", "artifact_id", "artifact_ids"),
    )
