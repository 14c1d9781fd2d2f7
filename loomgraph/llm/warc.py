"""WARC archives: written by Spark's text sink, read back by verified chains of record boundaries.

Writing: payloads of at least `LEAST` bytes that are equal are stored once, with
the smallest page_id; the others become revisit records that name it. A record
ends in two CRLFs, which is the sink's line separator, so archives are written
by Spark's own committed writer and a lost task leaves nothing behind.

Reading: files are cut into splits that are scanned apart. A scan emits every
candidate (the version line, a header with a length) with the offset at which
its successor would begin. Inside a split the candidates' chains are followed at
once, which leaves a pointer from each possible entry to its exit into a later
split; pointer jumping from the start of each file over these pointers, whatever
the file's size, doubling their reach each round, retains the entries that are truly reached. A version
line inside a payload is never the successor of a reached record, so it is
rejected. The splits are then read again from their entries.

Defined results: a null html is an empty payload; a payload under `LEAST` bytes
is always a response; rows that share the smallest page_id of equal payloads are
all responses; a null page_id revisits like any other and is named by nothing;
line breaks in a url become spaces; a payload of any length is one record, read
whole by the task of the split it begins in; an empty table gives an empty table. The
caller's other columns are not archived.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import scratch
from loomgraph.ship import ship

LEAST = 100
#: Bytes of a split; small, so that chains of many splits are the usual case and a task's memory is bounded by records, not files.
SPLIT = 256 << 10
#: Bytes read beyond a split at once, and those in which a header is looked for at first.
BEYOND, HEADER = 1 << 14, 1 << 16
#: Bytes of archives for each of the first `TASKS` tasks, and for each beyond them.
TASK, TASKS, LARGE = 16 << 20, 4096, 256 << 20
EPOCH = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal payloads told to every task at most; beyond that the join is shuffled.
FEW = 100_000
CRLF = "\r\n"


def _urn(page_id: Column) -> Column:
    h = F.md5(page_id.cast("string"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def roles(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) with ``payload_digest``, ``payload_bytes`` and, for revisits, ``refers_to``."""
    body = F.coalesce("html", F.lit(""))
    own = pages.withColumns({"payload_digest": F.sha2(body, 256), "payload_bytes": F.octet_length(body).cast("long")})
    first = own.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1 and __first is not null").drop("__n")
    first = scratch.write(first, "firsts")
    joined = own.join(F.broadcast(first) if first.count() <= FEW else first, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first"))).drop("__first")


def write(pages: DataFrame, date: str = EPOCH) -> str:
    """Write one record for each row of `pages` and return the folder of the archives."""
    rows = roles(pages.select("page_id", "url", "html"))
    body, revisit = F.coalesce("html", F.lit("")), F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, body))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    header = F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("?"), "payload_digest")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("Page-Id", F.col("page_id").cast("string")),
        line("Refers-To-Page-Id", F.col("refers_to").cast("string")),
        line("Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    at = scratch.fresh(pages.sparkSession, "warc")
    rows.select(F.concat(header, block).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "none").text(at)
    return at


class _File:
    """Byte ranges of a file in any store that Arrow can open."""

    def __init__(self, uri: str):
        scheme, _, rest = uri.partition(":")
        if scheme == "file":
            self.fs, path = pyarrow.fs.LocalFileSystem(), unquote("/" + rest.lstrip("/"))
        else:
            self.fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, end: int) -> bytes:
        return self.file.read_at(max(0, min(end, self.size) - start), start)


_START = re.compile(rb"WARC/\d\.\d\r\n")
_LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n")


def _header(f: _File, data: bytes, base: int, at: int) -> tuple[int, int] | None:
    """Where the block of the record at offset `at` begins and ends; `data` begins at `base`. None if it is no record."""
    lo, size = at - base, HEADER
    end = data.find(b"\r\n\r\n", lo)
    while end < 0:
        more = f.read(at, at + size)
        end = more.find(b"\r\n\r\n")
        if end >= 0:
            data, lo = more, 0
        elif len(more) < size:
            return None
        size *= 4
    m = _LENGTH.search(data, lo, end + 2)
    if not m:
        return None
    begin = at + end + 4 - lo
    return begin, begin + int(m[1])


def scan_split(f: _File, start: int, end: int) -> list[tuple[int, int]]:
    """Every candidate that begins in the split, with the offset of its successor."""
    data = f.read(start, end + BEYOND)
    out = []
    for m in _START.finditer(data):
        at = start + m.start()
        if at >= end:
            break
        if (got := _header(f, data, start, at)) and got[1] + 4 <= f.size and f.read(got[1], got[1] + 4) == b"\r\n\r\n":
            out.append((at, got[1] + 4))
    return out


def exits(edges: list[tuple[int, int]], end: int) -> list[int | None]:
    """Where the chain of each candidate leaves the split; None if it breaks off inside."""
    got: dict[int, int | None] = {}
    for at, successor in reversed(edges):
        got[at] = successor if successor >= end else got.get(successor)
    return [got[at] for at, _ in edges]


def splits(spark: SparkSession, folder: str, size: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("k"))
    return cut.select("path", "k", (F.col("k") * size).alias("start"), F.least((F.col("k") + 1) * size, F.col("length")).alias("stop"), "length")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, _File]]:
    """Rows with their files, each opened once while it is looked at."""
    path, file = None, None
    for b in batches:
        for r in sorted(b.to_pylist(), key=lambda r: (r["path"], r["k"])):
            if r["path"] != path:
                path, file = r["path"], _File(r["path"])
            yield r, file


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r, file in _rows(batches):
        edges = scan_split(file, r["start"], r["stop"])
        n = len(edges)
        at, nxt = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n, pa.string()), pa.array(np.full(n, r["k"])), pa.array(at), pa.array(nxt), pa.array(exits(edges, r["stop"]), pa.int64())], names=["path", "k", "at", "successor", "exit"])


def reachable(candidates: DataFrame) -> tuple[DataFrame, int]:
    """Entries ``(path, k, at)`` that the chain from each file's start reaches, by pointer jumping over split exits; and the rounds it took.

    After r rounds a pointer spans 2^r splits and all entries within 2^r splits of
    the start are reached; it ends with the round that reaches nothing new.
    """
    start = candidates.where("at = 0").select("path", "k", "at", F.col("exit").alias("next"))
    ends = candidates.select("path", F.col("exit").alias("at")).where("at is not null").distinct()
    entry = candidates.select("path", "k", "at", F.col("exit").alias("next"))
    jump = scratch.write(entry.join(ends, ["path", "at"], "left_semi").unionByName(start).distinct(), "jump")
    reach = scratch.write(start.select("path", "at"), "reach")
    ids, n, rounds = jump.select("path", "k", "at"), -1, 0
    while n != (now := reach.count()):
        n, rounds = now, rounds + 1
        step = jump.select("path", "at", "next")
        reach = scratch.write(reach.unionByName(reach.join(step, ["path", "at"]).select("path", F.col("next").alias("at"))).where("at is not null").distinct(), "reach")
        further = step.select("path", F.col("at").alias("next"), F.col("next").alias("after"))
        jump = scratch.write(step.join(further, ["path", "next"], "left").select("path", "at", F.col("after").alias("next")), "jump")
    return ids.join(reach, ["path", "at"]).select("path", "k", "at"), rounds


def walk(f: _File, at: int, stop: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Offset, header and block of each record of the chain from `at` that begins before `stop`."""
    base, data = at, f.read(at, stop + BEYOND)
    while at < stop and (got := _header(f, data, base, at)):
        begin, end = got
        whole = data if begin - base <= len(data) else None
        head = whole[at - base : begin - base] if whole is not None else f.read(at, begin)
        block = data[begin - base : end - base] if end - base <= len(data) else f.read(begin, end)
        yield at, head, block
        at = end + 4


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r, file in _rows(batches):
        rows: list[tuple] = []
        size = 0
        for at, head, block in walk(file, r["at"], r["stop"]):
            pairs = [x.partition(b":") for x in head.split(b"\r\n")[1:] if b":" in x]
            fields = [(a.decode("utf-8", "replace"), c.strip().decode("utf-8", "replace")) for a, _, c in pairs]
            http = any(a.lower() == "content-type" and c.lower().startswith("application/http") for a, c in fields)
            if http:
                block = block.partition(b"\r\n\r\n")[2]
            rows.append((r["path"], at, fields, block))
            size += len(block)
            if size > 4 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary())
    cols = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=["path", "at", "headers", "payload"])


def read(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """Records of all archives of `folder`: ``path``, ``at`` (offset), ``headers`` (map) and ``payload``."""
    ship(spark)
    cut = splits(spark, folder, split)
    parts, size = cut.agg(F.count("*"), F.sum(F.col("stop") - F.col("start"))).first()
    size = size or 0
    many = max(1, min(parts, max(spark.sparkContext.defaultParallelism, min(TASKS, size // TASK), size // LARGE)))
    found = cut.repartition(many, "path", "k").mapInArrow(_scan, "path string, k long, at long, successor long, exit long")
    entries, _ = reachable(scratch.write(found, "candidates"))
    todo = entries.join(cut.select("path", "k", "stop"), ["path", "k"])
    return todo.repartition(many, "path", "k").mapInArrow(_parse, "path string, at long, headers map<string,string>, payload binary")


def digest(records: DataFrame) -> DataFrame:
    """What each record says of its page; a response's figures come from the payload that was read."""
    h = lambda name: F.col("headers")[name]
    revisit = h("WARC-Type") == "revisit"
    return records.select(
        h("Page-Id").cast("long").alias("page_id"),
        F.when(revisit, h("Payload-Length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(h("WARC-Payload-Digest"), "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        h("WARC-Type").alias("record_type"),
        h("Refers-To-Page-Id").cast("long").alias("refers_to"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, write(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


ORACLE = f"""
WITH own AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_id FROM own WHERE payload_bytes >= {LEAST} GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM own LEFT JOIN firsts USING (payload_digest)
"""
