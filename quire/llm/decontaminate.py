"""Benchmark decontamination by winnowing, exact for every window of ten words.

Of every run of six consecutive 5-word hashes the least is kept (the last, on ties).
A shared span of ten words has the same six hashes on both sides, so both keep the
same one at the same place in it: joining the kept hashes finds every shared window. A
joined hash fixes how item and document lie to each other; comparing them word by word
along that line extends the hit and settles it. Items of fewer than ten words are
looked up whole, by the hash of as many words.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, drop_written, table, words, written

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM, RUN = 5, 6
WINDOW = GRAM + RUN - 1
#: The low bits of a kept hash hold its place, inverted so that the last of equals is least.
PLACE_BITS = 24
PLACES = (1 << PLACE_BITS) - 1
#: Bytes up to which the items' hashes, and the documents' hits, are broadcast, and of a row of
#: hashes. Beyond, the joins shuffle; a hot hash or document is then a skew join's to split.
BROADCAST_BYTES = 16 << 20
PRINT_BYTES = 40


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _steps(count: Column) -> Column:
    """0 .. count - 1, empty if count isn't positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def item_words(text: Column) -> Column:
    return words(ascii_lower(text), BREAK)


def gram(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(w, i + j) for j in range(n)])


def winnowed(w: Column) -> Column:
    """Kept hashes of an array of words, each with its place in its low bits."""
    hashes = F.transform(
        _steps(F.size(w) - (GRAM - 1)),
        lambda i: gram(w, i, GRAM).bitwiseAND(F.lit(~PLACES)).bitwiseOR((F.lit(PLACES).cast("bigint") - i).bitwiseAND(F.lit(PLACES).cast("bigint"))),
    )

    def least(h: Column) -> Column:
        return F.transform(_steps(F.size(h) - (RUN - 1)), lambda j: F.least(*[F.get(h, j + k) for k in range(RUN)]))

    changed = lambda m: F.filter(m, lambda x, j: (j == 0) | (x != F.get(m, j - 1)))
    return _let(hashes, lambda h: _let(least(h), changed))


def whole_grams(w: Column, n: int) -> Column:
    """The hash of every n words of ``w``, in the form of ``winnowed``."""
    return F.transform(
        _steps(F.size(w) - (n - 1)),
        lambda i: gram(w, i, n).bitwiseAND(F.lit(~PLACES)).bitwiseOR((F.lit(PLACES).cast("bigint") - i).bitwiseAND(F.lit(PLACES).cast("bigint"))),
    )


def _hash_of(kept: Column) -> Column:
    return F.shiftright(kept, PLACE_BITS)


def _place_of(kept: Column) -> Column:
    return F.lit(PLACES).cast("bigint") - kept.bitwiseAND(F.lit(PLACES).cast("bigint"))


def _bounded(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, kept) per row.

    n_hit counts the words inside occurrences of an item's windows; ``items`` are the
    ids, sorted as strings, of the items with such occurrences; ``kept`` is a struct of the
    columns in ``keep`` and is left out without any. A null or wordless text or
    item has no words; a null item id is left out of ``items``, not of the hits; rows
    with one id and different texts are told apart by their texts' hash; repeated rows
    give equal rows; other columns aren't read; an empty benchmark hits nothing. Places
    are kept modulo 2**24 words; all that agree with one are compared.
    """
    items = benchmark.select("item_id", item_words("text").alias("item")).filter(F.size("item") > 0).distinct()
    items = written(items.withColumn("item_no", F.monotonically_increasing_id()), "items")
    short = [r[0] for r in items.filter(F.size("item") < WINDOW).select(F.size("item")).distinct().collect()]
    kept = F.when(F.size("item") >= WINDOW, winnowed(F.col("item")))
    for n in sorted(short):
        kept = kept.when(F.size("item") == n, whole_grams(F.col("item"), n))
    prints = written(
        items.select("item_no", F.explode(kept).alias("kept")).select(
            _hash_of(F.col("kept")).alias("hash"), _place_of(F.col("kept")).alias("item_place"), "item_no"
        ),
        "prints",
    )
    size = prints.count() * PRINT_BYTES
    hashes = prints.select("hash").distinct()

    text = F.coalesce("text", F.lit(""))
    carried = [F.struct(*keep).alias("kept")] if keep else []
    rows = docs.select("doc_id", text.alias("text"), *carried).withColumn("text_hash", F.xxhash64("text"))
    of_words = lambda w: F.concat(winnowed(w), *[whole_grams(w, n) for n in short])
    found = (
        rows.select("doc_id", "text_hash", F.explode(_let(item_words(F.col("text")), of_words)).alias("kept"))
        .withColumn("hash", _hash_of(F.col("kept")))
        .join(_bounded(hashes, size), "hash", "left_semi")
        .select("doc_id", "text_hash", "hash", _place_of(F.col("kept")).alias("place"))
    )
    # how an item lies to a document, by numbers; the item's words come in once for each such pair
    lines = written(
        found.join(_bounded(prints, size), "hash")
        .groupBy("doc_id", "text_hash", "item_no")
        .agg(F.collect_set(F.col("place") - F.col("item_place")).alias("shifts")),
        "lines",
    )
    hits = written(
        lines.join(items, "item_no")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_list(F.struct("item_id", "item", "shifts")).alias("lines")),
        "hits",
    )
    held = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(F.array_join(x["item"], " ")) + 16 * F.size(x["item"]) + 8 * F.size(x["shifts"]) + 40)
    size = hits.agg(F.coalesce(F.sum(held + 40), F.lit(0))).first()[0]
    hit = _bounded(hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "lines"), size)
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    joined = rows.join(hit, same, "left").select("doc_id", "lines", item_words(F.col("text")).alias("w"), *keep and ["kept"])
    settled = joined.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.when(F.col("lines").isNotNull(), _let(F.col("w"), lambda w: _settle(w, F.col("lines")))).alias("s"),
        *keep and ["kept"],
    )
    none = F.array().cast(f"array<{dict(benchmark.dtypes)['item_id']}>")
    ids = F.array_sort(F.array_distinct(F.transform(F.coalesce("s.items", none), lambda x: x.cast("string"))))
    out = settled.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("s.places").cast("bigint"), F.lit(0).cast("bigint")).alias("n_hit"),
        F.filter(ids, lambda x: x.isNotNull()).alias("items"),
        *keep and ["kept"],
    )
    for t in (items, prints, lines):
        drop_written(t)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
        *keep and ["kept"],
    )


def _settle(w: Column, lines: Column) -> Column:
    """The places of ``w`` inside occurrences of windows, and the ids of their items."""

    def starts(line: Column, shift: Column) -> Column:
        """Where on the line a whole window agrees, as places in the item."""
        size = F.size(line["item"])
        long = F.least(size, F.lit(WINDOW))
        agree = F.array_join(
            F.transform(line["item"], lambda x, i: F.when(F.get(w, shift + i) == x, "1").otherwise("0")), ""
        )
        return _let(
            F.struct(agree.alias("a"), F.repeat(F.lit("1"), long).alias("all"), long.alias("n")),
            lambda v: F.filter(_steps(size - v["n"] + 1), lambda s: F.substring(v["a"], s + 1, v["n"]) == v["all"]),
        )

    def covered(line: Column) -> Column:
        size = F.least(F.size(line["item"]), F.lit(WINDOW))
        laps = F.sequence(F.lit(0), F.shiftright(F.size(w), PLACE_BITS))
        shifts = F.array_distinct(F.flatten(F.transform(line["shifts"], lambda x: F.transform(laps, lambda lap: (x + lap.cast("bigint") * F.lit(PLACES + 1)).cast("int")))))
        return F.flatten(
            F.transform(
                shifts,
                lambda shift: F.flatten(F.transform(starts(line, shift), lambda s: F.sequence(shift + s, shift + s + size - 1))),
            )
        )

    both = F.transform(lines, lambda line: F.struct(line["item_id"].alias("id"), covered(line).alias("p")))
    return _let(
        F.filter(both, lambda x: F.size(x["p"]) > 0),
        lambda hits: F.struct(
            F.array_distinct(F.flatten(F.transform(hits, lambda x: x["p"]))).alias("places"),
            F.array_distinct(F.transform(hits, lambda x: x["id"])).alias("items"),
        ),
    )


def op9_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, CAST(greatest(len(w) - 9, 1) AS BIGINT) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, s, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
