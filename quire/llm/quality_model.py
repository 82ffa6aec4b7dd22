"""Quality scores: ridge regression on random Fourier features, calibrated.

Document statistics are standardised and mapped to cosines of random projections,
whose inner products approximate a Gaussian kernel. Ridge regression on them needs
only sums over rows (the normal equations), which partitions add up; isotonic
regression on rows set apart turns scores into probabilities. Training rows are dealt
into BUCKETS by their ids' hash, and sums run over buckets in order and over ids
within them, so that a model doesn't depend on how Spark deals rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import labelled
from quire.llm.common import drop_written, ship, table, written

#: Training bound, features, kernel width in standard deviations, ridge, and the share of
#: training rows (1 in CALIBRATION) set apart for calibration.
TRAINING_ROWS = 20_000
N_FOURIER = 256
WIDTH = 4.0
RIDGE = 1.0
CALIBRATION = 4
#: Parts of the training rows that are added up by themselves, and rows scored at once.
BUCKETS = 8
BLOCK = 64
SEED = 20_250_101

_CLASSES = np.zeros((256, 8))
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b".,;:", b"!?", b"\"'()[]{}=_/\\@~^+-`", b" \t\r\v\f\n")):
    _CLASSES[list(_chars), _i] = 1
_CLASSES[128:, 7] = 1

N_STATS = 20


def statistics(text: str) -> list[float]:
    """Numbers that describe a text's form, not its words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    hist = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    share = (hist @ _CLASSES) / n
    p = hist[hist > 0] / n
    words = text.split()
    n_words = len(words)
    w = max(1, n_words)
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    grams = max(1, n_words - 2)
    distinct = len(set(zip(words, words[1:], words[2:], strict=False))) if n_words > 2 else grams
    longest = max(map(len, words), default=0)
    return [
        math.log1p(n_words),
        min(50.0, len(text) / w),
        *np.sqrt(share).tolist(),
        float(-(p * np.log2(p)).sum()),
        len(set(words)) / w,
        1 - distinct / grams,
        1 - len(set(lines)) / n_lines,
        math.log1p(n_words / n_lines),
        math.log1p(longest),
        sum(1 for x in words if x[-1] in "#*$%&|<>!") / w,
        sum(1 for x in words if x.isupper()) / w,
        sum(1 for x in words if len(x) == 1) / w,
        math.log1p(n_lines),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray  # N_STATS x N_FOURIER
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # scores at which the calibrated value rises
    values: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, self.directions, self.phases)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(weighted(self.fourier(x), self.weights), self.steps, self.values), 0, 1)


def fourier(z: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Cosine features with a constant."""
    z = np.clip(z, -8, 8)
    angle = np.zeros((len(z), len(phases)))
    for i in range(z.shape[1]):  # added one after another, so that a row's numbers don't depend on its block
        angle += z[:, i : i + 1] * directions[i]
    return np.hstack([np.sqrt(2 / len(phases)) * np.cos(angle + phases), np.ones((len(z), 1))])


def weighted(f: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each row's sum under the weights, whatever block it is in."""
    return (f * weights).sum(axis=1)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best rising fit of ``y`` by ``score``: pools adjacent violators.
    Equal scores are one point. A half row of each label is added to every pool, so
    that no value is exactly 0 or 1."""
    xs, place = np.unique(score, return_inverse=True)
    weight = np.bincount(place).astype(float)
    total = np.bincount(place, y)
    pools: list[list[float]] = []  # first, last, weight, total
    for x, w, t in zip(xs, weight, total, strict=True):
        pools.append([x, x, w, t])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, b, w2, t2 = pools.pop()
            pools[-1] = [pools[-1][0], b, pools[-1][2] + w2, pools[-1][3] + t2]
    px, py = [], []
    for a, b, w, t in pools:
        v = (t + 0.5) / (w + 1)
        px += [a, b] if b > a else [a]
        py += [v, v] if b > a else [v]
    return np.array(px), np.maximum.accumulate(np.array(py))


def described(train: DataFrame) -> DataFrame:
    """(bucket, doc_id, apart, label, stats) of every training row, written: the texts are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t or "") for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], stats], names=["bucket", "doc_id", "apart", "label", "stats"])

    by = lambda what, n: F.pmod(F.xxhash64("doc_id", F.lit(what)), F.lit(n))
    rows = train.select("text", by("bucket", BUCKETS).alias("bucket"), "doc_id", (by("calibrate", CALIBRATION) == 0).alias("apart"), "label")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"bucket bigint, doc_id {kind}, apart boolean, label int, stats array<double>"), "stats")


def summed(rows: DataFrame, part, width: int) -> np.ndarray:
    """The sum of ``part(x, y)``, a vector of ``width`` numbers, over the buckets of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        whole = pa.Table.from_batches(held) if held else None
        for bucket in sorted(set(whole["bucket"].to_pylist())) if held else ():
            own = whole.filter(pc.equal(whole["bucket"], bucket))
            made = part(np.array(own["stats"].to_pylist()), np.array(own["label"].to_pylist(), float) > 0)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "sums": pa.array([made.tobytes()], pa.binary())})

    dealt = rows.select("bucket", "doc_id", "label", "stats").repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "doc_id")
    got = dealt.select("bucket", "label", "stats").mapInArrow(run, "bucket bigint, sums binary").collect()
    return sum((np.frombuffer(r["sums"]) for r in sorted(got, key=lambda r: r["bucket"])), np.zeros(width))


def train_model(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Model | None:
    """The model of the labelled rows whose crc32(doc_id) mod 4 is not 2; None if there
    are none. The driver gets sums by bucket, and scores and labels of the calibration rows."""
    train = labelled.sample(docs, labels, "quality", labelled.fold(F.col("doc_id"), 4) != 2, training_rows)
    stats = described(train)
    drop_written(train)
    rows, held = stats.filter("not apart"), stats.filter("apart")
    sums = summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * N_STATS)
    n = sums[0]
    if not n:
        drop_written(stats)
        return None
    mean = sums[1 : 1 + N_STATS] / n
    scale = np.sqrt(np.maximum(sums[1 + N_STATS :] / n - mean**2, 1e-6))
    random = np.random.default_rng(SEED)
    directions = random.normal(size=(N_STATS, N_FOURIER)) / WIDTH
    phases = random.uniform(0, 2 * np.pi, N_FOURIER)
    d = N_FOURIER + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = fourier((x - mean) / scale, directions, phases)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    sums = summed(rows, equations, d * d + d)
    weights = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * np.eye(d), sums[d * d :])
    got = held.select("label", "stats").collect()
    drop_written(stats)
    if got:
        x, y = np.array([r["stats"] for r in got]), np.array([r["label"] > 0 for r in got], float)
        steps, values = isotonic(weighted(fourier((x - mean) / scale, directions, phases), weights), y)
    else:
        steps, values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return Model(mean, scale, directions, phases, weights, steps, values)


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the calibrated ``score`` of every row, in a narrow map.

    A null text counts as empty, which is scored by its statistics like any other;
    without a model every score is 0.5. Null keys stay; columns not named aren't read;
    repeated rows give repeated rows; no rows give none.
    """
    rows = docs.select(text, key)
    ship(docs.sparkSession)
    kind = rows.schema[1].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.full(batch.num_rows, 0.5)
            for i in range(0, batch.num_rows if model else 0, BLOCK):
                texts = batch.column(0).slice(i, BLOCK)
                made[i : i + BLOCK] = model.score(np.array([statistics(t.as_py() or "") for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made)], names=[key, "score"])

    return rows.mapInArrow(run, f"`{key}` {kind}, score double")


def op6_quality_model(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(labelled.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(docs, train_model(docs, labels)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
