"""Byte-level byte-pair encoding and decoding.

Each match of the splitting pattern is encoded by itself. A segment tree over
the match's byte positions holds, at the position of a live part, the rank of the
pair that it forms with its right neighbour. The root gives the smallest rank and,
on ties, the leftmost position; a merge changes the pairs of two live neighbours
and clears one position, three logarithmic updates in all. So a match of n bytes
costs O(n log n), also where it is a whole document without a space.

Matches recur, so each worker keeps a bounded table of those it has encoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.common import beside, ship, table

NONE = 1 << 40
#: Entries of a worker's table of encoded matches, and the longest match kept.
CACHE_ENTRIES = 400_000
CACHE_BYTES = 64
#: Tokens after which a worker hands on what it has.
BATCH_TOKENS = 1 << 20

COLUMNS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "n_tokens": ("bigint", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded": ("binary", pa.binary()),
    "decoded_sha256": ("string", pa.string()),
}


class RankTree:
    """Leftmost minimum over n positions with point updates."""

    def __init__(self, ranks: list[int]):
        size = 1
        while size < len(ranks):
            size *= 2
        self.size = size
        self.node = node = [NONE] * size + ranks + [NONE] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a <= b else b

    def put(self, i: int, rank: int) -> None:
        node = self.node
        i += self.size
        node[i] = rank
        while i > 1:
            a, b = node[i], node[i ^ 1]
            i >>= 1
            low = a if a <= b else b
            if node[i] == low:
                break
            node[i] = low

    def first_least(self) -> int:
        """The leftmost position of the least rank, -1 if no pair is left."""
        node = self.node
        least = node[1]
        if least == NONE:
            return -1
        i = 1
        while i < self.size:
            i *= 2
            if node[i] != least:
                i += 1
        return i - self.size


class Codec:
    """A vocabulary of ranks with its encoder and decoder."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.decimal = {b: str(b) for b in self.bytes_of}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}
        self.most = CACHE_ENTRIES

    def encode_match(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        rank_of = ranks.get
        tree = RankTree([rank_of(piece[i : i + 2], NONE) for i in range(n - 1)])
        end = list(range(1, n + 1))  # of the live part that starts at i
        before = list(range(-1, n - 1))  # start of the live part left of it
        while (i := tree.first_least()) >= 0:
            j = end[i]
            stop = end[j]
            end[i] = stop
            if j < n - 1:
                tree.put(j, NONE)
            if stop < n:
                before[stop] = i
                tree.put(i, rank_of(piece[i : end[stop]], NONE))
            else:
                tree.put(i, NONE)
            if (h := before[i]) >= 0:
                tree.put(h, rank_of(piece[h:stop], NONE))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        cache, ids = self.cache, []
        for match in self.split(text):
            known = cache.get(match)
            if known is None:
                piece = match.encode("utf-8")
                known = self.encode_match(piece)
                if len(piece) <= CACHE_BYTES:
                    if len(cache) >= self.most:
                        cache.clear()
                    cache[match] = known
            ids += known
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(
    docs: DataFrame,
    outputs: tuple[str, ...] = ("ids", "n_tokens"),
    vocabulary: str | None = None,
    pattern: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    cache_entries: int = CACHE_ENTRIES,
) -> DataFrame:
    """``key``, the columns in ``keep`` and the asked-for ``outputs`` for every row, in a narrow map.

    outputs: of ``ids``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by
    a space), ``decoded`` and ``decoded_sha256`` (both made from the ids).
    vocabulary: a file of base64 token and rank a line, present on every executor.
    cache_entries: encoded matches that a worker remembers, about 250 bytes each.
    A null text counts as empty, which has no tokens; a null key stays null; other
    columns are not read; a kept column that has an output's name gives way to it;
    repeated rows give repeated rows; no rows give none.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pat = pattern or public_tokenizers.PATTERN
    keep = beside(keep, outputs)
    rows = docs.select(key, text, *keep)
    ship(docs.sparkSession)
    kinds = [f.dataType.simpleString() for f in rows.schema]
    names = [key, *keep]
    schema = ", ".join([*(f"`{c}` {k}" for c, k in zip(names, kinds[:1] + kinds[2:], strict=True)), *(f"{c} {COLUMNS[c][0]}" for c in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pat)
        c.most = cache_entries

        def made(batch: pa.RecordBatch, start: int, got: dict[str, list]) -> pa.RecordBatch:
            part = batch.slice(start, len(next(iter(got.values()))))
            return pa.RecordBatch.from_arrays(
                [part.column(0), *part.columns[2:], *(pa.array(v, COLUMNS[o][1]) for o, v in got.items())],
                names=[*names, *got],
            )

        for batch in batches:
            start, tokens = 0, 0
            got: dict[str, list] = {o: [] for o in outputs}
            for i, value in enumerate(batch.column(1)):
                ids = c.encode(value.as_py() or "")
                tokens += len(ids)
                if "ids" in got:
                    got["ids"].append(np.array(ids, np.int32))
                if "n_tokens" in got:
                    got["n_tokens"].append(len(ids))
                if "ids_sha256" in got:
                    got["ids_sha256"].append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                if "decoded" in got or "decoded_sha256" in got:
                    back = c.decode(ids)
                    if "decoded" in got:
                        got["decoded"].append(back)
                    if "decoded_sha256" in got:
                        got["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                if tokens >= BATCH_TOKENS:
                    yield made(batch, start, got)
                    start, tokens, got = i + 1, 0, {o: [] for o in outputs}
            if start < batch.num_rows:
                yield made(batch, start, got)

    return rows.mapInArrow(run, schema)


def op8_byte_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), ("n_tokens", "ids_sha256", "decoded_sha256"))
