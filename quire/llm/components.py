"""Connected components by alternating star contractions on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_written, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v): the least node reachable.

    Large-star and small-star steps in turn until the links stop changing, a number of
    rounds that grows with the logarithm of the longest chain. Minima are combined
    map-side; a hub's links meet its minimum in a join that can be split. The links of
    each round are written, so a lost executor costs no more than that round.
    """
    ends = F.explode(F.array(F.struct(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))).alias("e")
    now = written(links.filter("u <> v").select(ends).select("e.u", "e.v").distinct(), "links")
    state = _state(now)
    for _ in range(most_rounds):
        before, now = now, written(_small_star(_large_star(now)), "links")
        drop_written(before)
        state, last = _state(now), state
        if state == last:
            break
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's least neighbour or itself."""
    both = links.select("u", "v").union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    least = written(least, "least")  # a plain table, so that a hub's links can be split in the join
    return both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), "least")
    moved = down.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("n").alias("u"), F.col("m").alias("v"))
    return moved.union(own).filter("u <> v").distinct()
