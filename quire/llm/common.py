"""Shared plumbing: reading tables and word patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import drop_written, new_path, remove, scope, ship, written

__all__ = ["SPACES", "WORD_BREAK", "Query", "ascii_lower", "beside", "drop_written", "fresh", "new_path", "remove", "scope", "ship", "table", "words", "written"]

#: Characters that separate words in most contracts: space, \t, \n, \v, \f, \r.
SPACES = "\x20\t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text, break_pattern: str = WORD_BREAK):
    """The words of a text column; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), break_pattern), lambda w: w != "")


def beside(keep: tuple[str, ...], outputs) -> tuple[str, ...]:
    """The columns of ``keep`` that have no output's name; the session may not tell cases apart."""
    taken = {c.lower() for c in outputs}
    return tuple(c for c in dict.fromkeys(keep) if c.lower() not in taken)


def fresh(columns: list[str], name: str) -> str:
    """``name``, or with enough underscores behind it to differ from every column's."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


Query = Callable[[SparkSession, str], DataFrame]
