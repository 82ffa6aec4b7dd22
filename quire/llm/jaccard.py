"""Exact Jaccard join on word shingles, to components, by prefixes under several orders.

Two sets with similarity t share so many tokens that the first few tokens of each, under
any one order of all tokens, must have tokens in common - at least
``alpha - (n - p)`` of them, for an overlap of alpha, a set of n and its prefix of p.
Three orders are used, all with tokens that are frequent in the corpus last, and within
a class of frequency by different hashes. Candidates come from the first order's postings,
and must pass the size, position and overlap conditions of that order and of the two
others before they are verified on the whole texts.

How it stays within bounds on groups of copies:
- Texts with equal sets are one node from the start.
- Links are wanted only as far as they join components. In every posting list the member
  that has the token earliest (the one with the fewest tokens of its own) is a hub,
  and others are first tried against hubs only. Then, in the lists whose members are not
  yet in one component, pairs from different components are tried, all of them. So no
  link between components is lost, and pairs inside a component are not made.
- Every list is counted by its key alone, map-side, and its members and hub meet in joins
  of plain tables, which Spark can split. A long list that is still open is cut by the
  tokens of its members' prefixes under the second order: linked members share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import drop_written, fresh, ship, table, written
from quire.llm.components import components

#: A shingle counts as frequent if so many of the documents of one chunk have it; a chunk
#: is about so many shingles. The table of frequent shingles keeps so many at most; which
#: shingles it has changes the order of tokens, and so the speed, but never the result.
CHUNK_COUNT = 3
CHUNK_SHINGLES = 1 << 22
FREQUENT = 1_000_000
#: Open lists of more members are cut by the second order's tokens before pairs are made.
LONG_LIST = 1000
#: Ids up to this many are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_CLASS = np.uint64(58)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; linked if per_mille * union <= 1000 * intersection."""

    words: int
    per_mille: int

    @property
    def t(self) -> float:
        return self.per_mille / 1000

    def prefix(self, n: int) -> int:
        return n - -(-n * self.per_mille // 1000) + 1

    def linked(self, same: int, a: int, b: int) -> bool:
        return 1000 * same >= self.per_mille * (a + b - same)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of ``text``, A-Z lower-cased;
    with fewer words, of the whole sequence."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    n = len(h) - k + 1
    s = h[:n].copy()
    for j in range(1, k):
        s = _mix(s) + h[j : j + n]
    return np.unique(_mix(s))


class Orders:
    """Prefixes under the orders that a table of frequent shingles gives."""

    def __init__(self, frequent: np.ndarray, classes: np.ndarray):
        self.frequent, self.classes = frequent, classes

    def prefixes(self, s: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first p keys of each order: class of frequency and hash; those of the second
        and third cut to 32 bits, which can only add candidates."""
        cls = np.zeros(len(s), np.uint64)
        if len(self.frequent):
            at = np.searchsorted(self.frequent, s)
            at[at == len(self.frequent)] = 0
            hit = self.frequent[at] == s
            cls[hit] = self.classes[at[hit]]
        top = cls << _CLASS
        out = []
        for x in (s, _mix(s ^ _B), _mix(s ^ _C)):
            key = top | (_mix(x) >> np.uint64(6))
            if p < len(key):
                key = np.partition(key, p - 1)[:p]
            out.append(np.sort(key))
        cut = lambda k: np.unique((k & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
        return out[0].view(np.int64), cut(out[1]), cut(out[2])


def _survey(docs: DataFrame, rule: Rule) -> DataFrame:
    """One pass over the texts: a row per document (doc_id, n, s1, s2: its set's
    128-bit signature), and rows of locally frequent shingles (token, count)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        id_type = pa.int64()

        def frequent() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            held.clear()
            tokens.sort()  # in place, as the chunk is a worker's largest array
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            counts = np.diff(first, append=len(tokens))
            often = counts >= CHUNK_COUNT
            return batch_of([None] * int(often.sum()), token=tokens[first[often]].view(np.int64), count=counts[often])

        def batch_of(ids, n=None, s1=None, s2=None, token=None, count=None) -> pa.RecordBatch:
            none = pa.nulls(len(ids), pa.int64())
            col = lambda x: none if x is None else pa.array(x, pa.int64())
            ids = pa.nulls(len(ids), id_type) if token is not None else ids
            return pa.RecordBatch.from_arrays(
                [ids, col(n), col(s1), col(s2), col(token), col(count), pa.array([token is None] * len(ids), pa.bool_())],
                names=["doc_id", "n", "s1", "s2", "token", "count", "is_doc"],
            )

        for batch in batches:
            id_type = batch.column(0).type
            n, s1, s2 = [], [], []
            for value in batch.column(1):
                s = shingles(value.as_py() or "", rule.words)
                n.append(len(s))
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                s1.append((d >> 64) - (1 << 63))
                s2.append((d & ((1 << 64) - 1)) - (1 << 63))
                if len(s):
                    held.append(s)
                    size += len(s)
                if size >= CHUNK_SHINGLES:
                    yield frequent()
                    size = 0
            yield batch_of(batch.column(0), n, s1, s2)
        if held:
            yield frequent()

    schema = f"doc_id {kind}, n bigint, s1 bigint, s2 bigint, token bigint, count bigint, is_doc boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _orders(survey: DataFrame) -> Orders:
    """The driver gets two numbers for each of at most FREQUENT shingles, as Arrow arrays whatever the
    session's settings are: a task has merged and cut them, and they never are rows of Python objects."""
    top = (
        survey.filter("not is_doc")
        .groupBy("token")
        .agg(F.sum("count").alias("count"))
        .orderBy(F.desc("count"), "token")
        .limit(FREQUENT)
        .toArrow()
    )
    tokens = top["token"].to_numpy().view(np.uint64)
    classes = np.clip(np.floor(2 * np.log2(np.maximum(top["count"].to_numpy(), 2))), 1, 63).astype(np.uint64)
    order = np.argsort(tokens)
    return Orders(tokens[order], classes[order])


def _prefixes(docs: DataFrame, rule: Rule, orders: Orders) -> DataFrame:
    """(id, n, k1, k2, k3) of every document with words and an id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((orders.frequent, orders.classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Orders(*shared.value)
        for batch in batches:
            rows, n, keys = [], [], ([], [], [])
            for i, value in enumerate(batch.column(1)):
                s = shingles(value.as_py() or "", rule.words)
                if len(s):
                    rows.append(i)
                    n.append(len(s))
                    for out, k in zip(keys, known.prefixes(s, rule.prefix(len(s))), strict=True):
                        out.append(k)
            types = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), *(pa.array(k, t) for k, t in zip(keys, types, strict=True))],
                names=["id", "n", "k1", "k2", "k3"],
            )

    schema = f"id {kind}, n bigint, k1 array<bigint>, k2 array<int>, k3 array<int>"
    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, schema)


def _alpha(a: Column, b: Column, rule: Rule) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil((a + b) * F.lit(rule.per_mille) / F.lit(1000 + rule.per_mille) - 1e-9)


def _may_match(na: Column, pa_: Column, nb: Column, pb: Column, rule: Rule) -> Column:
    """Size and position conditions of a token that stands at places pa_ and pb."""
    alpha = _alpha(na, nb, rule)
    return (
        (F.least(na, nb) * 1000 >= F.greatest(na, nb) * rule.per_mille)
        & (na - pa_ >= alpha)
        & (nb - pb >= alpha)
    )


def _posting_lists(reps: DataFrame) -> DataFrame:
    """Members (key, id, n, pos, hub, size) of all lists of the first order with two or more;
    the hub is a struct of pos, n and id. Written."""
    posts = reps.select("id", "n", F.posexplode("k1").alias("pos", "key"))
    shared = written(posts.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    members = written(posts.join(shared, "key"), "members")
    hubs = written(members.groupBy("key").agg(F.min(F.struct("pos", "n", "id")).alias("hub")), "hubs")
    lists = written(members.join(hubs, "key").select("key", "id", "n", "pos", "hub", "size"), "lists")
    for t in (shared, members, hubs):
        drop_written(t)
    return lists


def _across(open_: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of members of one list that aren't in one component and may match."""
    columns = ("id", "n", "pos", "label")

    def pairs(rows: DataFrame, on: list[str]) -> DataFrame:
        left, right = (rows.select(*on, *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in "xy")
        apart = F.col("x_label") < F.col("y_label")
        match = _may_match(F.col("x_n"), F.col("x_pos"), F.col("y_n"), F.col("y_pos"), rule)
        return left.join(right, on).filter(apart & match).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))

    short, long = (written(open_.filter(c), "open") for c in (F.col("size") <= LONG_LIST, F.col("size") > LONG_LIST))
    found = pairs(short, ["key"])
    if not long.isEmpty():
        second = reps.select(F.col("id").alias("second_id"), F.explode("k2").alias("second"))
        cut = written(long.join(second, F.col("id") == F.col("second_id")).drop("second_id"), "cut")
        found = found.unionByName(pairs(cut, ["key", "second"]))
    return found.distinct()


def _few(ids: DataFrame) -> DataFrame:
    """``ids`` to be broadcast if a count shows that there are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("pair_id")).distinct()


def _filtered(pairs: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose prefixes overlap enough under every order.

    The first order's filter comes first, and what passes it meets the others'; only the
    prefixes of documents that are still in question enter a join.
    """
    slack = F.greatest(F.col("a_n") - F.col("a_p"), F.col("b_n") - F.col("b_p"))
    least = F.greatest(_alpha(F.col("a_n"), F.col("b_n"), rule) - slack, F.lit(1))

    def enough(k: str) -> Column:
        # a cut key can stand for two tokens of a prefix; what it hides is allowed for
        lost = F.greatest(F.col("a_p") - F.size(f"a_{k}"), F.col("b_p") - F.size(f"b_{k}"))
        return F.size(F.array_intersect(f"a_{k}", f"b_{k}")) >= least - lost

    for keys in (("k1",), ("k2", "k3")):
        pairs = written(pairs, "pairs")
        few = reps.join(_few(_ids(pairs)), F.col("id") == F.col("pair_id"), "left_semi")
        few = written(few.select("id", "n", F.size("k1").alias("p"), *keys), "picked")
        a, b = (few.select(*[F.col(c).alias(f"{x}_{c}") for c in few.columns]) for x in "ab")
        both = pairs.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id"))
        for k in keys:
            both = both.filter(enough(k))
        pairs = both.select("a", "b")
    return pairs


def _verified(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) whose whole texts are linked. ``pairs`` must be written."""
    texts = docs.join(_few(_ids(pairs)), F.col("doc_id") == F.col("pair_id")).select(
        F.col("pair_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")
    )
    texts = written(texts, "texts")
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    kind = joined.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.empty(0, np.uint64)
        for batch in batches:
            good = []
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = a.as_py(), b.as_py()
                if b != last:
                    last, known = b, shingles(b, rule.words)
                s = shingles(a, rule.words)
                if rule.linked(len(np.intersect1d(s, known, assume_unique=True)), len(s), len(known)):
                    good.append(i)
            yield batch.select(["u", "v"]).take(pa.array(good, pa.int64()))

    links = joined.select(F.col("a").alias("u"), F.col("b").alias("v"), "text_a", "text_b").mapInArrow(run, f"u {kind}, v {kind}")
    out = written(links, "verified")
    drop_written(texts)
    return out


def join(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over links, exact for every threshold.
    A null or wordless text has no shingles and is linked with nothing; a null id is
    linked with nothing and has a null component; rows that share an id are one node,
    with the links of each of their texts, and give a row each; other columns aren't
    read; no rows give none.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    survey = written(_survey(rows, rule), "survey")
    orders = _orders(survey)
    members = survey.filter("is_doc").select("doc_id", "n", "s1", "s2")
    # written, so that the joins with it shuffle plainly and a hot signature can be split
    groups = written(
        members.filter("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "groups"
    )
    copies = written(_copies(members, groups), "copies")
    reps = written(_first_ones(rows, copies, groups, rule, orders), "prefixes")
    lists = _posting_lists(reps)

    own, hub = (F.col("n"), F.col("pos")), (F.col("hub.n"), F.col("hub.pos"))
    stars = lists.filter((F.col("id") != F.col("hub.id")) & _may_match(*own, *hub, rule)).select(
        F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")
    )
    tried = written(_filtered(stars.distinct(), reps, rule), "stars")
    star_links = _verified(tried, rows, rule)
    labels = written(components(star_links.unionByName(copies)), "labels")

    placed = lists.drop("hub").join(_few(labels), F.col("id") == F.col("node"), "left").select(
        "key", "id", "n", "pos", "size", F.coalesce("component", "id").alias("label")
    )
    open_keys = (
        placed.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("key")
    )
    open_ = written(placed.join(open_keys, "key", "left_semi"), "open")
    across = _across(open_, reps, rule).join(tried, ["a", "b"], "left_anti")
    rest = written(_filtered(across, reps, rule), "rest")
    more = _verified(rest, rows, rule)
    contracted = (
        more.join(labels.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
        .join(labels.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
        .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    )
    final = components(contracted).select(F.col("node").alias("old"), F.col("component").alias("new"))
    for t in (open_, lists, reps):
        drop_written(t)
    named = members.join(labels, F.col("doc_id") == F.col("node"), "left").withColumn(
        "c", F.coalesce("component", "doc_id")
    )
    return named.join(final, F.col("c") == F.col("old"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("new", "c").alias("component_id")
    )


def _first_ones(docs: DataFrame, copies: DataFrame, groups: DataFrame, rule: Rule, orders: Orders) -> DataFrame:
    """Prefixes of the documents that are the first of an equal set. Where few aren't, they are
    left out of the texts' scan; else the prefixes meet the first ones' ids in a join."""
    gone = copies.select(F.col("u").alias("gone")).distinct().join(groups, F.col("gone") == F.col("rep"), "left_anti")
    if gone.count() <= BROADCAST_IDS:
        return _prefixes(docs.join(F.broadcast(gone), F.col("doc_id") == F.col("gone"), "left_anti"), rule, orders)
    return _prefixes(docs, rule, orders).join(groups.select("rep").distinct(), F.col("id") == F.col("rep"), "left_semi")


def _copies(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (u, v) of documents with the first one of an equal set."""
    return (
        members.filter("n > 0 and doc_id is not null")
        .join(groups, ["s1", "s2"])
        .filter("doc_id <> rep")
        .select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    )


def one_of_each(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first by doc_id of their component.

    Of rows that share an id the one with the least text stays. Rows without words or
    without an id stay.
    """
    gone, twice, place = (fresh(docs.columns, name) for name in ("gone", "twice", "place"))
    classes = written(join(docs, rule), "classes")
    lost = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    several = classes.filter("doc_id is not null").groupBy(F.col("doc_id").alias(twice)).agg(F.count("*").alias("n")).filter("n > 1").select(twice)
    left = docs.join(_few(lost), F.col("doc_id") == F.col(gone), "left_anti")
    if several.isEmpty():
        return left
    several = _few(several)
    shared = left.join(several, F.col("doc_id") == F.col(twice), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in ("text", *[c for c in docs.columns if c not in ("doc_id", "text")])])
    first = shared.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return left.join(several, F.col("doc_id") == F.col(twice), "left_anti").unionByName(first)


def op4_jaccard_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"), Rule(3, 900))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 2, 1) AS BIGINT) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT u AS a, v AS b FROM e UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
