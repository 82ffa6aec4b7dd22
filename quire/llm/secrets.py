"""Secret scans: patterns of known forms, and a token-efficiency test for the rest.

A byte-pair vocabulary spells ordinary words and identifiers in few tokens but random
strings in many, so a string of few characters per token is likely a key. Looked at are
runs of letters, digits and the signs of base64 and of paths. Cut out of them first is
what a pattern has found and what is of a well-known harmless form (digests, UUIDs,
integrity values, dates) between signs or ends, so that a key or a path before it
changes nothing. What is left is tested in parts between equals signs: as a whole, or
by its path's names. Separators and short numbers cost tokens in any identifier, so of
these only the letters are asked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from quire.llm import bpe
from quire.llm.common import beside, ship, table

KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more: the same as all runs, less the shorter ones

#: Runs that the token-efficiency test looks at, the shortest part of one that it tests, and
#: the most characters per token for a finding.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
MAX_CHARS_PER_TOKEN = 1.9
LETTER = re.compile(r"[A-Za-z]")
#: Strings of random but harmless form.
HARMLESS = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"[0-9a-fA-F]{128}|[0-9a-fA-F]{96}|[0-9a-fA-F]{64}|[0-9a-fA-F]{56}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32}"  # digests
    r"|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"  # UUIDs
    r"|[0-7][0-9A-HJKMNP-TV-Z]{25}"  # ULIDs
    r"|sha(?:1|256|384|512)[-=][A-Za-z0-9+/]{20,}={0,2}"  # integrity values
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}[0-9Z+-]*)?|[0-9]{8}T[0-9]{4,6}Z?"  # dates
    r")(?![A-Za-z0-9])"
)
#: Parts of a run: what stands between equals signs, those at its end being padding.
PART = re.compile(r"[^=]+(?:=+\Z)?")
NAME = re.compile(r"[^/]+")
#: Identifiers and paths: words, numbered words and short numbers. Of them, words of two letters or more are asked.
IDENTIFIER = re.compile(
    r"(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}[a-z]{0,2})(?:[-_/](?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}[a-z]{0,2}))+/?\Z"
)
WORD = re.compile(r"[A-Za-z]{2,}")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns in code points, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def hungry(part: str, codec: bpe.Codec, most: float) -> bool:
    """Whether a string with letters has few characters per token; an identifier, whether its
    words have, or a long one of them (of a path, which is long, its names are asked later)."""
    if not LETTER.search(part):
        return False
    words = WORD.findall(part) if IDENTIFIER.match(part) else []
    if not words:
        return len(part) <= most * len(codec.encode(part))
    size = [len(codec.encode(w)) for w in words]
    return sum(map(len, words)) <= most * sum(size) or (
        "/" not in part and any(len(w) >= LEAST and len(w) <= most * n for w, n in zip(words, size, strict=True))
    )


def random_spans(text: str, known: list[Span], codec: bpe.Codec, most: float) -> list[Span]:
    """Token-hungry parts of runs, outside ``known`` (by start) and harmless forms."""
    found: list[Span] = []
    stretches = _stretches(known)
    at = 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while at < len(stretches) and stretches[at][1] <= a:
            at += 1
        cuts = [(x.start() + a, x.end() + a) for x in HARMLESS.finditer(m[0])]
        k = at
        while k < len(stretches) and stretches[k][0] < b:
            cuts.append(stretches[k])
            k += 1
        for s, e in _outside(a, b, sorted(cuts)):
            if e - s < LEAST:
                continue
            for part in PART.finditer(text[s:e]):
                if len(part[0]) < LEAST:
                    continue
                start = s + part.start()
                names = [x for x in NAME.finditer(part[0]) if LEAST <= len(x[0]) < len(part[0]) and hungry(x[0], codec, most)]
                blob = not IDENTIFIER.match(part[0])  # its slashes are base64's
                if (blob or not names) and hungry(part[0], codec, most):
                    found.append((start, 3, s + part.end()))
                else:
                    found += [(start + x.start(), 3, start + x.end()) for x in names]
    return found


def _stretches(spans: list[Span]) -> list[tuple[int, int]]:
    """What spans, by start, cover: stretches that don't touch, in order."""
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _outside(a: int, b: int, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a .. b without the cuts, which are in order."""
    for s, e in cuts:
        if s > a:
            yield a, s
        a = max(a, e)
    if a < b:
        yield a, b


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """``text`` with every stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    reach = -1
    for s, _, e in spans:
        if s >= reach:
            out += [text[at:s], mark]
        reach = at = max(reach, e)
    return "".join([*out, text[at:]])


OUTPUTS = {
    "n_assign": pa.int64(),
    "n_access": pa.int64(),
    "n_hex": pa.int64(),
    "n_random": pa.int64(),
    "base_sha256": pa.string(),
    "spans": pa.string(),
    "redacted": pa.string(),
}
SQL_TYPE = {pa.int64(): "bigint", pa.string(): "string"}


def scan(
    docs: DataFrame,
    outputs: tuple[str, ...] = tuple(OUTPUTS),
    key: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    vocabulary: str | None = None,
    max_chars_per_token: float = MAX_CHARS_PER_TOKEN,
    mark: str = "[SECRET]",
) -> DataFrame:
    """``key``, the columns in ``keep``, and ``outputs`` for every row, in a narrow map.

    spans: ``kind:start:end`` of all findings by start, then kind, comma-joined (code
    points, end exclusive); base_sha256: the digest of those of the fixed patterns;
    redacted: the text with findings replaced. A null text counts as empty, but its
    ``redacted`` is null; a null key stays; columns not named are not read, so they
    can't clash; a kept column that has an output's name gives way to it; repeated rows
    give repeated rows; no rows give none; a text costs time in proportion to its length.
    Overlapping findings of different kinds are all reported and redacted as one stretch.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    keep = beside(keep, outputs)
    rows = docs.select(key, text, *keep)
    ship(docs.sparkSession)
    names = [key, *keep]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"{c} {SQL_TYPE[OUTPUTS[c]]}" for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path, public_tokenizers.PATTERN)
        for batch in batches:
            got: dict[str, list] = {o: [] for o in outputs}
            for value in batch.column(1):
                raw = value.as_py()
                s = raw or ""
                base = base_spans(s)
                spans = sorted(base + random_spans(s, base, codec, max_chars_per_token))
                n = [0, 0, 0, 0]
                for _, k, _ in spans:
                    n[k] += 1
                made = {
                    "n_assign": n[0],
                    "n_access": n[1],
                    "n_hex": n[2],
                    "n_random": n[3],
                    "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
                    "spans": joined(spans),
                    "redacted": redacted(s, spans, mark) if spans else raw,
                }
                for o in outputs:
                    got[o].append(made[o])
            kept = [batch.column(0), *(batch.column(2 + i) for i in range(len(keep)))]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(v, OUTPUTS[o]) for o, v in got.items())], names=[*names, *got]
            )

    return rows.mapInArrow(run, schema)


def op1_secret_scan(spark, sf_dir):
    return scan(
        table(spark, sf_dir, "documents"), ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
    )
