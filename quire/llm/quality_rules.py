"""Quality rules whose cutoffs adapt to each language and source.

Each document gives a few integer statistics. Per language, source and statistic a
quantile sketch is kept of the documents that pass the base rule: counts of log-spaced
buckets, whose edges are at most a sixteenth of the value apart. Sketches merge by adding
counts, so they aggregate map-side and a hot source costs no more rows than a small one; a
language's and the whole table's come from the sources'. A language's sketch takes in
PRIOR documents dealt as the table's are, and a source's PRIOR dealt as its language's, so
that small groups lean on what they are part of and large ones on themselves, without a
size at which that changes. A document fails a rule where its statistic lies beyond a fence
of SPREADS spreads outside its group's quantiles.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACES, table, words, written

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Statistic, the quantiles (in twentieths) whose distance is its spread, the least spread (a few of
#: the finest buckets, or about one repeat in a short text), whether it has a lower fence. Statistics
#: that most documents have at 0 and some legitimately above take the upper tail for a spread.
RULES = (
    ("symbol_rate", 15, 5, 4, False),  # symbols to 1000 characters of words
    ("dup_line_rate", 19, 10, 40, False),  # repeated lines to 1000 lines
    ("repeat_rate", 19, 10, 40, False),  # repeated words to 1000 words
    ("capital_rate", 15, 5, 6, False),  # letters A-Z to 1000 characters of words
    ("word_length", 15, 5, 4, True),  # mean, in tenths of a character
)
SPREADS = 5
#: Documents that a group's sketch takes in from the group that it is part of, and parts of a document counted.
PRIOR = 100
PARTS = 1000


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``w``.

    The windows' hashes are sorted with their places; neighbours that agree are
    repeats, and each place covers up to its next one. O(n log n) in the row.
    """
    n = F.size(w)
    places = F.when(n >= 4, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    grams = F.array_sort(
        F.transform(
            places,
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
    )

    def covered(g: Column) -> Column:
        hits = F.filter(
            g,
            lambda x, k: (F.get(g, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(g, k - 1)["h"] == x["h"])),
        )
        return F.array_sort(F.transform(hits, lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return _let(grams, lambda g: _let(covered(g), total))


def _let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """One narrow row per document: ids, the counts, and the rules' statistics."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"))
    word = words(F.col("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        _let(word, of_words_struct).alias("w"),
        F.length(F.translate("text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", CAPITALS, ""))).cast("bigint").alias("n_capitals"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("l"),
    )
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_capitals",
        (F.col("l.n") - F.col("l.d")).cast("bigint").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"),
        F.col("l.n").cast("bigint").alias("n_lines"),
    )


def of_words_struct(w: Column) -> Column:
    return F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).alias("r"))


def rates(stats: DataFrame) -> DataFrame:
    whole = lambda a, b: F.expr(f"({a}) div greatest({b}, 1)")
    return stats.withColumns(
        {
            "symbol_rate": whole("1000 * n_symbols", "word_chars"),
            "dup_line_rate": whole("1000 * n_dup_lines", "n_lines"),
            "repeat_rate": whole("1000 * n_repeat_words", "n_words"),
            "capital_rate": whole("1000 * n_capitals", "word_chars"),
            "word_length": whole("10 * word_chars", "n_words"),
        }
    )


def bucket(v: Column) -> Column:
    """Lower edge of a value's bucket: exact below 32, else five leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the sketch of each source, of rows that pass the base rule."""
    values = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), bucket(F.col(r)).alias("bucket")) for r, *_ in RULES])
    )
    return (
        stats.filter(~base_failed())
        .select("lang", "source", values.alias("v"))
        .groupBy("lang", "source", "v.rule", "v.bucket")
        .agg(F.count("*").alias("n"))
    )


def leaning(own: DataFrame, group: list[str], on: list[str], above: DataFrame) -> DataFrame:
    """(group, rule, bucket, n) of each group's sketch with PRIOR documents dealt as ``above``, the
    sketch of what it is part of by ``on``. Counts are in PARTS of a document."""
    shares = above.select(
        *[F.col(c).alias(f"above_{c}") for c in (*on, "rule")], "bucket", F.col("n").cast("decimal(38,0)").alias("n"),
        F.sum("n").over(Window.partitionBy(*on, "rule")).cast("decimal(38,0)").alias("total"),
    )
    part_of = F.col("rule") == F.col("above_rule")
    for c in on:
        part_of = part_of & F.col(c).eqNullSafe(F.col(f"above_{c}"))
    taken = (
        own.select(*group, "rule")
        .distinct()
        .join(shares, part_of)
        .select(*group, "rule", "bucket", F.expr(f"cast((n * {PRIOR * PARTS}) div total as bigint)").alias("n"))
    )
    whole = own.select(*group, "rule", "bucket", (F.col("n") * PARTS).alias("n")).unionByName(taken)
    return whole.groupBy(*group, "rule", "bucket").agg(F.sum("n").alias("n"))


def fences(fine: DataFrame) -> DataFrame:
    """(lang, source, a low and a high fence per rule) from the sources' sketches."""
    merged = lambda *group: fine.groupBy(*group, "rule", "bucket").agg(F.sum("n").alias("n"))
    of_lang = leaning(merged("lang"), ["lang"], [], merged())
    sketch = leaning(fine, ["lang", "source"], ["lang"], of_lang)
    group = Window.partitionBy("lang", "source", "rule")
    ranked = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    at = lambda q: F.min(F.when(F.col("upto") * 20 >= F.col("total") * q, F.col("bucket")))
    made = []
    quantiles = ranked.groupBy("lang", "source", "rule").agg(*[at(q).alias(f"q{q}") for q in sorted({q for _, hi, lo, _, _ in RULES for q in (hi, lo)})])
    for rule, hi, lo, least, lower in RULES:
        spread = F.greatest(F.col(f"q{hi}") - F.col(f"q{lo}"), F.lit(least)) * SPREADS
        made.append(F.max(F.when(F.col("rule") == rule, F.col(f"q{hi}") + spread)).alias(f"{rule}_high"))
        if lower:
            made.append(F.max(F.when(F.col("rule") == rule, F.col(f"q{lo}") - spread)).alias(f"{rule}_low"))
    return quantiles.groupBy("lang", "source").agg(*made)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document.

    Nulls: a null text has no words, so it fails the base rule; a null language or
    source is a group like any other; a null ``doc_id`` is kept. Repeated rows are
    judged and counted each. Other columns are not read. No rows give none. A value at a
    fence passes.

    The statistics are written once in the shared folder, since the sketches and the
    verdicts both read them; texts never enter a shuffle. Every group of a document that
    passes the base rule has its row of cutoffs, so one join serves all; its hot key is
    one that a skew join splits.
    """
    stats = rates(written(statistics(docs), "rules"))
    fine = written(sketches(stats), "sketches")
    cutoffs = fences(fine).withColumnsRenamed({"lang": "c_lang", "source": "c_source"})
    cutoffs = written(cutoffs, "cutoffs")  # a plain table, so that the join below can be split
    failed = F.lit(False)
    for rule, *_, lower in RULES:
        failed = failed | (F.col(rule) > F.col(f"{rule}_high"))
        if lower:
            failed = failed | (F.col(rule) < F.col(f"{rule}_low"))
    return (
        stats.join(cutoffs, F.col("lang").eqNullSafe(F.col("c_lang")) & F.col("source").eqNullSafe(F.col("c_source")), "left")
        .withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~F.coalesce(failed, F.lit(False))})
        .drop("c_lang", "c_source", "lang", "source")
    )


def op7_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    b = "((v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0))"
    values = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {r} AS v FROM stats WHERE NOT base" for r, *_ in RULES)
    rules = ", ".join(f"('{r}', {hi}, {lo}, {least})" for r, hi, lo, least, _ in RULES)
    made = []
    for rule, _, _, _, lower in RULES:
        made.append(f"max(CASE WHEN rule = '{rule}' THEN qh + {SPREADS} * greatest(qh - ql, least) END) AS {rule}_high")
        if lower:
            made.append(f"max(CASE WHEN rule = '{rule}' THEN ql - {SPREADS} * greatest(qh - ql, least) END) AS {rule}_low")
    bad = " OR ".join([f"{r} > {r}_high" for r, *_ in RULES] + [f"{r} < {r}_low" for r, *_, low in RULES if low])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS c FROM g WHERE w3 IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE c >= 2 GROUP BY r),
n AS (SELECT r, count(*) AS n_words FROM w GROUP BY r),
ln AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
counts AS (
  SELECT d.r, doc_id, lang, source, coalesce(n_words, 0) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM d JOIN ln USING (r) LEFT JOIN n USING (r) LEFT JOIN rep USING (r)),
stats AS (SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_rate, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate,
  1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate, 1000 * n_capitals // greatest(word_chars, 1) AS capital_rate, 10 * word_chars // greatest(n_words, 1) AS word_length,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base FROM counts),
rules(rule, hi, lo, least) AS (VALUES {rules}),
fine AS (SELECT lang, source, rule, {b} AS bucket, count(*) AS n FROM ({values}) GROUP BY ALL),
whole AS (SELECT rule, bucket, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY rule) AS total FROM fine GROUP BY rule, bucket),
langs AS (SELECT lang, rule, bucket, sum(n) AS n FROM (SELECT lang, rule, bucket, {PARTS} * n AS n FROM fine
  UNION ALL SELECT lang, rule, bucket, {PRIOR * PARTS} * n // total FROM (SELECT DISTINCT lang, rule FROM fine) JOIN whole USING (rule)) GROUP BY ALL),
part AS (SELECT *, sum(n) OVER (PARTITION BY lang, rule) AS total FROM langs),
own AS (SELECT lang, source, rule, bucket, sum(n) AS n FROM (SELECT lang, source, rule, bucket, {PARTS} * n AS n FROM fine
  UNION ALL SELECT g.lang, g.source, rule, bucket, {PRIOR * PARTS} * n // total FROM (SELECT DISTINCT lang, source, rule FROM fine) g JOIN part USING (rule) WHERE part.lang IS NOT DISTINCT FROM g.lang) GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, rule) AS total FROM own),
q AS (SELECT lang, source, rule, any_value(least) AS least, min(CASE WHEN upto * 20 >= total * hi THEN bucket END) AS qh, min(CASE WHEN upto * 20 >= total * lo THEN bucket END) AS ql FROM ranked JOIN rules USING (rule) GROUP BY ALL),
cut AS (SELECT lang, source, {', '.join(made)} FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed, NOT base AND NOT coalesce({bad}, false) AS kept
FROM stats LEFT JOIN cut ON cut.lang IS NOT DISTINCT FROM stats.lang AND cut.source IS NOT DISTINCT FROM stats.source"""
