"""Toxicity scores: a fuzzy lexicon, contexts, and a small logistic model.

The lexicon is a fixed list of insults and the stems that labelled training documents
show to go with toxicity, in any language, each with a strength: what a document's
having it says for toxicity against what an insult says. Words are matched by
``lexicon.Matcher``, misspellings included. A finding counts less where its window of
words shows that it is quoted or spoken about. Forms within an edit of a term, and
beginnings within an edit of a stem, that clean training documents use as well are
ordinary words and are left out.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import labelled
from quire.llm.common import beside, drop_written, ship, table
from quire.llm.lexicon import Matcher, stem_edits_allowed

#: Insults that hold without training.
INSULTS = (
    "idiot", "moron", "imbecile", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum",
    "clown", "trash", "garbage", "filth", "dumbass", "bastard", "asshole", "retard",
)
#: Words that report speech, before or after a quotation.
REPORTING = frozenset(
    "said says wrote writes quoted quote quotes called calls word words term saying "
    "sagte sagt schrieb wort nannte dit disait mot appelé dijo dice palabra llamó".split()
)
QUOTES = "\"“”«»„‟"

#: Labelled documents sampled for training, and lengths of the beginnings of words tried as stems.
TRAINING_ROWS = 10_000
PREFIXES = range(2, 11)
#: A learned stem is in this share of toxic documents among those that have it, and its count of them
#: says so with this many nats against the share of all.
MAJORITY = 0.45
EVIDENCE = 6.5
#: From this share on a stem may be misspelt.
SURE = 0.95
#: Nats by which a stem raises the odds of toxicity that count as much as an insult.
FULL = 6.0
#: A toxic document counts as covered with so many chosen stems; each must add so many documents.
COVERS = 2
NEW_DOCUMENTS = 4
#: Words on each side that a context looks at, and what a quoted finding counts.
WINDOW = 5
QUOTED = 0.25

WORD = re.compile(r"[\w@$]+")
#: Signs of WORD that may stand at a word's ends for no letter.
SIGNS = "@$_"
_LEET = str.maketrans("0134578@$", "oleastbas")


def plain(word: str) -> str:
    """Digits and signs that stand for letters, undone where letters are present."""
    return word.translate(_LEET) if not word.isalpha() and not word.isdigit() else word


def forms(word: str) -> list[str]:
    """The word in plain letters: with signs at its ends as letters, and without them."""
    if word.strip(SIGNS) == word:
        return [plain(word)]
    return [plain(w) for w in dict.fromkeys((word, word.rstrip(SIGNS), word.lstrip(SIGNS), word.strip(SIGNS))) if w]


def prefix_counts(text: str) -> set[str]:
    out = set()
    for word in set(WORD.findall(text.lower())):
        for w in forms(word):
            for n in PREFIXES:
                if len(w) < n:
                    break
                out.add(w[:n])
    return out


class Stem(NamedTuple):
    stem: str
    strength: float = 1.0
    sure: bool = True


def learn_stems(train: DataFrame) -> tuple[Stem, ...]:
    """Stems that go with label 1 in ``train``, from summed counts of documents.

    Equal texts count once. The driver gets the beginnings with enough evidence, and
    which of them each toxic document has: what the sampled documents hold, at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p in prefix_counts(text):
                    got.setdefault(p, [0, 0])[y > 0] += 1
                if len(got) > 500_000:
                    yield _counted(got)
                    got = {}
        yield _counted(got)

    texts = train.groupBy("text").agg(F.max("label").alias("label"))
    n, toxic = texts.agg(F.count("*"), F.count_if(F.col("label") > 0)).first()
    if not toxic or toxic == n:
        return ()
    t, c = F.col("toxic"), F.col("clean")
    part = lambda k, share: F.when(k > 0, k * F.log(k / ((t + c) * share))).otherwise(0.0)
    sums = (
        texts.mapInArrow(count, "prefix string, clean bigint, toxic bigint")
        .groupBy("prefix")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .withColumn("evidence", part(t, toxic / n) + part(c, 1 - toxic / n))
        .filter((F.col("evidence") >= EVIDENCE) & (t >= MAJORITY * (t + c)))
    )
    rows = {r["prefix"]: r for r in sums.collect()}
    candidates = frozenset(longest({p: r["toxic"] for p, r in rows.items()}))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = [sorted(prefix_counts(t) & candidates) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"has": pa.array(has, pa.list_(pa.string()))})

    has = [r["has"] for r in texts.filter("label > 0").select("text").mapInArrow(cover, "has array<string>").collect()]
    picked = chosen(has, {p: rows[p]["evidence"] / rows[p]["toxic"] for p in candidates})
    return tuple(_stem(p, rows[p]["clean"], rows[p]["toxic"], n - toxic, toxic) for p in picked)


def _stem(prefix: str, clean: int, toxic: int, all_clean: int, all_toxic: int) -> Stem:
    raised = math.log((toxic + 0.5) / (all_toxic + 1) * (all_clean + 1) / (clean + 0.5))
    return Stem(prefix, min(1.0, max(0.0, raised / FULL)), toxic >= SURE * (clean + toxic))


def longest(count: dict[str, int]) -> set[str]:
    """Of beginnings of one another, those that say most without losing documents."""
    out = set(count)
    for p, n in count.items():
        out.difference_update(q for k in range(1, len(p)) if (q := p[:k]) in count and n >= 0.97 * count[q])
    return out


def chosen(has: list[list[str]], worth: dict[str, float]) -> list[str]:
    """Stems that cover toxic documents which those before don't: words that only copies
    of one document share add nothing once its real terms are in. ``worth``: what a stem
    says of each document. Gains only fall, so one that still leads when worked out anew is best."""
    holders: dict[str, set[int]] = {}
    for i, prefixes in enumerate(has):
        for p in prefixes:
            holders.setdefault(p, set()).add(i)
    picked: list[str] = []
    covered: Counter = Counter()
    done: set[int] = set()
    queue = [(-len(d) * worth[p], p) for p, d in holders.items()]
    heapq.heapify(queue)
    while queue:
        was, p = heapq.heappop(queue)
        new = len(holders[p] - done)
        if new < NEW_DOCUMENTS:
            continue
        if -new * worth[p] > was:
            heapq.heappush(queue, (-new * worth[p], p))
            continue
        for i in holders[p]:
            covered[i] += 1
            if covered[i] >= COVERS:
                done.add(i)
        picked.append(p)
    return sorted(picked)


def _counted(got: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "prefix": pa.array(got, pa.string()),
            "clean": pa.array([c for c, _ in got.values()], pa.int64()),
            "toxic": pa.array([t for _, t in got.values()], pa.int64()),
        }
    )


@dataclass
class Finding:
    form: str  # the word as matched; of a stem, its beginning
    term: str
    edits: int
    weight: float  # by its context and strength


class Finder:
    """Findings of a text; remembers a bounded number of words of bounded length."""

    MOST_WORDS = 100_000
    MOST_LETTERS = 64

    def __init__(self, terms: tuple[str, ...], stems: tuple[Stem, ...], ordinary: frozenset[str] = frozenset()):
        self.strength = {s.stem: s.strength for s in stems} | dict.fromkeys(terms, 1.0)
        sure = frozenset(s.stem for s in stems if s.sure)
        self.matcher = Matcher(terms, [s.stem for s in stems], lambda s: stem_edits_allowed(s) if s in sure else 0)
        self.ordinary = ordinary
        self.known: dict[str, tuple[str, str, int] | None] = {}

    def lookup(self, word: str) -> tuple[str, str, int] | None:
        """(form, term, edits) of a word."""
        if word in self.known:
            return self.known[word]
        found = None
        for form in forms(word):
            if near := self.matcher.nearest(form):
                term, edits, taken = near
                if not (edits and form[:taken] in self.ordinary) and (found is None or edits < found[2]):
                    found = (form[:taken], term, edits)
        if len(word) <= self.MOST_LETTERS:
            if len(self.known) >= self.MOST_WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def find(self, text: str) -> tuple[list[Finding], int]:
        """The findings, and the number of words."""
        lowered = text.lower()
        words = WORD.findall(lowered)
        hits = {w: f for w in set(words) if (f := self.lookup(w))}
        if not hits:
            return [], len(words)
        places = [(m.start(), m.end()) for m in WORD.finditer(lowered)]
        weight = lambda w, i: self.strength[hits[w][1]] * self.context(lowered, words, places, i)
        return [Finding(*hits[w], weight(w, i)) for i, w in enumerate(words) if w in hits], len(words)

    @staticmethod
    def context(text: str, words: list[str], places: list[tuple[int, int]], i: int) -> float:
        """1 for plain abuse, less where the window around word i is one of quotation."""
        near = range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1))
        start, end = places[i]
        before, after = text[places[near[0]][0] : start], text[end : places[near[-1]][1]]
        within = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after for q in QUOTES)
        tight = text[max(0, start - 1) : start] in set(QUOTES) | {"'"} and text[end : end + 1] in set(QUOTES) | {"'"}
        told = any(words[j] in REPORTING for j in near)
        if tight or (within and told):
            return QUOTED
        return 0.5 + QUOTED / 2 if within else 1.0


def features(found: list[Finding], n_words: int) -> list[float]:
    sure = sum(f.weight for f in found if f.edits == 0)
    all_ = sure + sum(f.weight * (1 - 1.2 * f.edits / len(f.term)) for f in found if f.edits > 0)
    return [min(all_, 1.0), math.log1p(all_), min(10.0, 100.0 * all_ / max(n_words, 1)) / 10]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights with the intercept last, by Newton's method with step halving."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (reg * w * w).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(reg + 1e-6), x.T @ (p - y) + reg * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    terms: tuple[str, ...]
    stems: tuple[Stem, ...]
    ordinary: frozenset[str]
    weights: tuple[float, ...]

    def finder(self) -> Finder:
        return Finder(self.terms, self.stems, self.ordinary)

    def score(self, found: list[Finding], n_words: int) -> float:
        z = sum(a * b for a, b in zip([*features(found, n_words), 1.0], self.weights, strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


#: Without labelled rows: any plain exact finding is toxic.
UNTRAINED = (4.0, 1.0, 2.0, -3.0)


def train_model(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """The model of the labelled rows whose crc32(doc_id) mod 3 is not 1.

    The driver gets the learned stems, the ordinary words near terms, and three numbers for
    each of at most ``training_rows`` sampled documents.
    """
    train = labelled.sample(docs, labels, "toxic", labelled.fold(F.col("doc_id"), 3) != 1, training_rows)
    rows = train.select("text", "label")
    stems = learn_stems(train)

    def misspelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(INSULTS, stems)
        for batch in batches:
            uses: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for form in {f.form for f in finder.find(text)[0] if f.edits}:
                    uses.setdefault(form, [0, 0])[y > 0] += 1
            yield _counted(uses)

    used = (
        rows.mapInArrow(misspelt, "prefix string, clean bigint, toxic bigint")
        .groupBy("prefix")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter("clean > 0 and clean * 4 >= toxic")
    )
    ordinary = frozenset(r["prefix"] for r in used.select("prefix").collect())

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(INSULTS, stems, ordinary)
        for batch in batches:
            yield pa.RecordBatch.from_pydict(
                {"x": pa.array([features(*finder.find(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), "label": batch.column(1)}
            )

    # in an order of their own, so that the sums don't depend on how rows were dealt
    got = sorted((*r["x"], r["label"] > 0) for r in rows.mapInArrow(described, "x array<double>, label int").collect())
    drop_written(train)
    y = np.array([r[-1] for r in got], float)
    if not len(y) or y.min() == y.max():
        return Model(INSULTS, stems, ordinary, UNTRAINED)
    return Model(INSULTS, stems, ordinary, tuple(fit_logistic(np.array([r[:-1] for r in got]), y).tolist()))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, ``score`` and the number of ``findings`` of every row, in a narrow map.

    A null text counts as empty and gets the score of no findings; null values in kept
    columns stay; columns not named aren't read; repeated rows give repeated rows; no
    rows give none; a text's score depends on nothing but the text and the model.
    """
    keep = beside(keep, ("score", "findings"))
    rows = docs.select(text, *keep)
    ship(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double", "findings bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = model.finder()
        for batch in batches:
            scores, counts = [], []
            for value in batch.column(0):
                hits, n = finder.find(value.as_py() or "")
                scores.append(model.score(hits, n))
                counts.append(len(hits))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(1 + i) for i in range(len(keep))), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())],
                names=[*keep, "score", "findings"],
            )

    return rows.mapInArrow(run, schema)


def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(labelled.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return score(docs, train_model(docs, labels)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "findings"
    )
