"""WARC archives: written by Spark's text writer, read back, and assembled.

Each capture is a transaction of three records: the response (or a revisit of an equal
payload), the request, and a metadata record; the last two name the first in
WARC-Concurrent-To, and a revisit names the response's record in WARC-Refers-To.

Every record is a gzip member of its own. The text writer's line separator is an empty
gzip member, so part files are plain multi-member WARC files on any store that Spark
writes to, with its committer's care for lost tasks, and Spark's text reader can
split them between records: a task holds one record at a time, however large a file is.
Assembly joins records by their identifiers and gives one nested row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import new_path, remove, scope, ship, table, written

END = "\r\n"
DATE = "2025-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are always stored.
MIN_REVISIT_BYTES = 1000
#: An empty gzip member, which stands after each record's; and records in a file at most.
MEMBER_END = bytes.fromhex("1f8b0800000000000003" "0300" "0000000000000000")
RECORDS_PER_FILE = 100_000

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("concurrent_to", T.ArrayType(T.StringType())),
        T.StructField("target_uri", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_start", T.IntegerType()),
        T.StructField("block", T.BinaryType()),
    ]
)
_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("target_uri", pa.string()),
        ("page_id", pa.int64()),
        ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload_start", pa.int32()),
        ("block", pa.binary()),
    ]
)


def decide_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, serial, refers_page, refers_serial) of every row.

    Rows are written once with a serial of their own, which names their records. The
    response of each digest is found by a map-side combined maximum; large payloads
    meet it in one equi-join on the digest, whose hot keys a skew join splits. Smaller
    ones have a null key there, dealt out by their row so that they don't meet.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumns(
        {
            "digest": F.sha1(F.encode("payload", "UTF-8")),
            "large": F.octet_length("payload") >= MIN_REVISIT_BYTES,
            "serial": F.monotonically_increasing_id(),
        }
    )
    rows = written(rows, "captures")
    first = (
        rows.filter("large")
        .groupBy(F.col("digest").alias("of"))
        .agg(F.max(F.struct("page_id", (-F.col("serial")).alias("s"))).alias("r"), F.count("*").alias("copies"))
        .filter("copies > 1 and r.page_id is not null")
        .select("of", F.col("r.page_id").alias("response"), (-F.col("r.s")).alias("response_serial"))
    )
    first = written(first, "responses")  # a plain table, so that the join below can be split
    # a key of their own keeps the small ones apart; it can't equal a digest
    key = F.when(F.col("large"), F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("serial").cast("string")))
    joined = rows.withColumn("key", key).join(first, F.col("key") == F.col("of"), "left")
    refers = lambda c: F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col(c))
    return joined.select(
        "page_id", "url", "payload", "digest", "serial", refers("response").alias("refers_page"), refers("response_serial").alias("refers_serial")
    )


def _header(*lines: tuple[str, Column]) -> Column:
    """Header lines in order; those whose value is null are left out."""
    parts = [F.lit("WARC/1.1" + END)]
    parts += [F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(END)), F.lit("")) for name, value in lines]
    return F.concat(*parts, F.lit(END))


def _record(kind: Column, ident: Column, block: Column, more: list[tuple[str, Column]]) -> Column:
    length = F.octet_length(block).cast("string")
    return F.concat(
        _header(
            ("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", F.lit(DATE)), *more, ("Content-Length", length)
        ),
        block,
    )


def records(decided: DataFrame) -> DataFrame:
    """One text per record, three for each row of ``decide_revisits``."""
    line_safe = lambda c: F.regexp_replace(c, "[\r\n]", "%0A")
    urn = lambda kind, page="page_id", serial="serial": F.concat(
        F.lit(f"<urn:x-{kind}:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(":"), F.col(serial).cast("string"), F.lit(">")
    )
    revisit = F.col("refers_serial").isNotNull()
    size = F.octet_length("payload").cast("string")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size, F.lit(END + END)
    )
    uri = line_safe(F.col("url"))
    page = F.col("page_id").cast("string")
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        urn("capture"),
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
        [
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
            ("WARC-Refers-To", F.when(revisit, urn("capture", "refers_page", "refers_serial"))),
            ("Page-ID", page),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
    )
    ask = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}{END}"))
    request = _record(
        F.lit("request"),
        urn("request"),
        ask,
        [
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", urn("capture")),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
    )
    metadata = _record(
        F.lit("metadata"),
        urn("metadata"),
        F.concat(F.lit("payload-length: "), size, F.lit(END)),
        [
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", urn("capture")),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
    )
    return decided.select(F.explode(F.array(request, response, metadata)).alias("record"))


def member(record: bytes) -> bytes:
    """A record as one gzip member, which never holds MEMBER_END: where a block that can't be
    packed would have it as it is, blocks end inside it."""
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    made = packed.compress(record + (END + END).encode()) + packed.flush()
    if MEMBER_END not in made:
        return made
    packed, out, done = zlib.compressobj(6, zlib.DEFLATED, 31), [], 0
    while (at := record.find(MEMBER_END, done)) >= 0:
        cut = at + len(MEMBER_END) // 2
        out += [packed.compress(record[done:cut]), packed.flush(zlib.Z_FULL_FLUSH)]
        done = cut
    out += [packed.compress(record[done:] + (END + END).encode()), packed.flush()]
    return b"".join(out)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, size = [], 0
        for record in batch.column(0):
            held.append(member(record.as_py().encode("utf-8")))
            size += len(held[-1])
            if size >= 8 << 20:
                yield pa.RecordBatch.from_pydict({"member": pa.array(held, pa.binary())})
                held, size = [], 0
        yield pa.RecordBatch.from_pydict({"member": pa.array(held, pa.binary())})


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes three records per row of ``pages`` (page_id, url, html) under ``path``.

    A null html is an empty payload, a null url or page_id is left out of the
    headers; line ends in a url are percent-encoded; repeated rows are captures each;
    other columns are not read; no rows give an archive without records.
    """
    spark = pages.sparkSession
    ship(spark)
    with scope(spark):  # the captures' table goes once their archives are written
        members = records(decide_revisits(pages)).mapInArrow(_members, "member binary")
        # a string column carries the bytes as they are; the separator is given in a one-byte encoding
        (
            members.select(F.col("member").cast("string").alias("value"))
            .write.option("lineSep", MEMBER_END.decode("latin-1"))
            .option("encoding", "ISO-8859-1")
            .option("maxRecordsPerFile", records_per_file)
            .text(path)
        )


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of a WARC stream, record by record."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        length = int(headers["content-length"][0])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a WARC record is cut short")
        yield headers, block


def describe_record(headers: dict[str, list[str]], block: bytes, keep_block: bool) -> dict:
    one = lambda name: headers.get(name, [None])[0]
    kind = one("warc-type")
    size = digest = start = None
    if kind in ("response", "revisit"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        start = len(head) + len(gap)
        digest = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
        if kind == "response":
            size, made = len(payload), hashlib.sha1(payload).hexdigest()
            if digest not in (None, made):
                raise ValueError(f"payload digest of {one('warc-record-id')} doesn't hold")
            digest = made
        else:
            found = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            size = int(found[1]) if found else None
    page = one("page-id")
    return {
        "record_id": one("warc-record-id"),
        "record_type": kind,
        "concurrent_to": headers.get("warc-concurrent-to", []),
        "target_uri": one("warc-target-uri"),
        "page_id": int(page) if page is not None else None,
        "refers_to": one("warc-refers-to"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload_start": start,
        "block": block if keep_block else None,
    }


def read_archives(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records under ``path``; ``block`` is null unless ``blocks``, payload_start is where a
    payload begins in it.

    Files are read between empty gzip members, record by record where ``write_archives``
    made them; other WARC files, of gzip members in any number or plain, are one piece each, which a
    task must hold. A record that is cut short or whose digest doesn't hold fails.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for piece in batch.column(0):
                raw = piece.as_buffer()
                stream: io.BufferedIOBase = pa.BufferReader(raw)
                if raw.size >= 2 and raw[:2].to_pybytes() == b"\x1f\x8b":
                    stream = gzip.GzipFile(fileobj=stream)
                for headers, block in parse_records(io.BufferedReader(stream, 1 << 16)):
                    held.append(describe_record(headers, block, blocks))
                    size += len(block) if blocks else 200
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, _ARROW)

    files = spark.read.option("lineSep", MEMBER_END.decode("latin-1")).option("encoding", "ISO-8859-1").option("pathGlobFilter", "part-*")
    return files.text(path).select(F.col("value").cast("binary")).mapInArrow(run, RECORD)


def assemble(recs: DataFrame) -> DataFrame:
    """One row per response or revisit, with its requests and metadata nested.

    A record belongs to a capture if either names the other in WARC-Concurrent-To, or if
    it names a request that belongs to it. Identifiers are unique, so every join is on a
    near-unique key. Captures without partners have empty arrays; records whose
    identifier is null are captures without partners; partners without a capture are
    left out. ``recs`` is read several times, so it should be a written table.
    """
    captures = recs.filter("record_type in ('response', 'revisit')")
    others = recs.filter("record_type in ('request', 'metadata')")
    other_columns = ["record_id", "record_type", "target_uri", "block"]
    named = others.select("record_id", "record_type", F.explode("concurrent_to").alias("target"))
    naming = captures.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture"))
    ids = captures.select(F.col("record_id").alias("capture")).filter("capture is not null")
    direct = named.join(ids, F.col("target") == F.col("capture")).select("record_id", "capture").union(naming)
    by_request = (
        named.filter("record_type = 'metadata'")
        .join(direct.select(F.col("record_id").alias("request"), F.col("capture")), F.col("target") == F.col("request"))
        .select("record_id", "capture")
    )
    owner = direct.union(by_request).distinct()
    nested = (
        others.select(*other_columns)
        .join(owner, "record_id")
        .groupBy("capture")
        .agg(
            *[
                F.array_sort(
                    F.collect_list(F.when(F.col("record_type") == kind, F.struct("record_id", "target_uri", "block")))
                ).alias(name)
                for kind, name in (("request", "requests"), ("metadata", "metadata"))
            ]
        )
    )
    empty = F.array().cast("array<struct<record_id:string,target_uri:string,block:binary>>")
    return captures.join(nested, F.col("record_id") == F.col("capture"), "left").select(
        *[c for c in captures.columns if c != "concurrent_to"],
        F.coalesce("requests", empty).alias("requests"),
        F.coalesce("metadata", empty).alias("metadata"),
    )


def op2_warc(spark, sf_dir):
    """Sizes and digests are worked out from the assembled captures' payloads; a revisit, which
    has none, gives those of its headers. Its page is looked up by the record it names. The
    archives are the query's own and go once all their records are in a table."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    recs = written(read_archives(spark, path), "records")
    remove(spark, path)
    payload = F.when(F.col("record_type") == "response", F.expr("substring(block, payload_start + 1)"))
    got = assemble(recs).select(
        "page_id",
        F.coalesce(F.octet_length(payload).cast("bigint"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha1(payload), "payload_digest").alias("payload_digest"),
        "record_type",
        F.coalesce("refers_to", F.concat(F.lit("-"), "record_id")).alias("key"),  # no record's id for those that refer to none
        F.size("requests").alias("n_requests"),
        F.size("metadata").alias("n_metadata"),
    )
    named = recs.filter("record_type = 'response'").select(F.col("record_id").alias("named"), F.col("page_id").alias("refers_to"))
    referred = recs.filter("record_type = 'revisit'").select(F.col("refers_to").alias("named")).distinct()
    targets = written(named.join(referred, "named"), "targets")
    return got.join(targets, F.col("key") == F.col("named"), "left").drop("key", "named")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response <> page_id THEN response END AS refers_to, 1 AS n_requests, 1 AS n_metadata
FROM p LEFT JOIN m ON m.payload_digest = p.payload_digest AND payload_bytes >= 1000
"""
