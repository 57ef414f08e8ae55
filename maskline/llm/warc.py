"""WARC archives: written as text parts, read back in ranges by boundary chains.

A record says in its header how long it is, so each record names its successor,
and the records of a file are those that a walk from the file's start meets.
Files are read in ranges that know nothing of each other.  Every task emits, for
its range, each *candidate* (a line that begins with the magic and a header that
parses) with its successor's offset; the magic inside a payload makes candidates
too.  Inside a range numpy jumps pointers until each candidate knows where its
chain leaves the range.  Between ranges the exits are nodes of a table, whose
links are doubled in joins, from the start of each file, until nothing new is
reached.  A range is entered at one offset at most; from there a second pass
reads the records.  What no chain from the start reaches is never a record.

Archives are Spark text parts whose rows end with the record separator, so
Spark's committer makes a retried task harmless.  Ranges and links are tables in
the shared folder; no path, offset or page is brought to the driver.

Payloads are equal when their SHA-1, a second hash and their lengths are.

Defined cases: null html is an empty payload; an empty table writes no record;
a null id is written as an empty name and read as null, and comes before all
others where the largest id is sought; rows of one id and payload are records of
one type each; a line break in a URL is written as %0D or %0A; further columns
are not archived.  A record that its file's end cuts off, and all that follows a
place where no record begins, is left out; ``coverage`` says how far each file
was read.  Payloads of any bytes and length are read whole, one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm.store import stored

#: Smallest payload that a revisit may stand for.
REVISITED = 1000
#: Bytes that one task looks through; grows with the archives so that ranges stay below MANY.
SMALLEST_RANGE, LARGEST_RANGE, MANY = 4 << 20, 256 << 20, 4096
#: Bytes read at a time.
SLICE = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"WARC/1."
_START = re.compile(b"\n(?=WARC/1\\.)")
_FIELD = rb"[!#$%&'*+.^_`|~0-9A-Za-z-]++:[^\r\n]*+\r\n(?:[ \t][^\r\n]*+\r\n)*+"
_HEADER = re.compile(rb"WARC/1\.[0-9]\r\n(?:" + _FIELD + rb")++\r\n")
#: What may still become a header when more bytes come.
_OPEN = re.compile(rb"WARC/1\.(?:[0-9](?:\r(?:\n(?:" + _FIELD + rb")*+[^\r\n]*+\r?)?)?)?\Z")
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*\r\n", re.IGNORECASE)
RANGE = "path string, size long, low long, starts array<long>, ends array<long>, exits array<long>"
RECORD = (
    "path string, offset long, warc_type string, record_id string, target_uri string, refers_to string, digest string, "
    "payload_bytes long, payload binary"
)


def _lines(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _name(page_id: Column) -> Column:
    return F.coalesce(F.url_encode(page_id.cast("string")), F.lit(""))


def write(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    smallest: int = REVISITED,
) -> None:
    """A record for each page: a response, or a revisit of the equal payload with the largest id."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("html"))
    key = lambda frame: frame.withColumns(
        {"n": F.octet_length("html").cast("long"), "sha": F.sha1("html"), "check": F.xxhash64("html")}
    )
    equal = key(rows).where(F.col("n") >= smallest).groupBy("sha", "check", "n").agg(F.max("id").alias("first"), F.count("*").alias("copies"))
    repeated = stored(equal.where("copies > 1").drop("copies"))
    found = key(rows).join(repeated, ["sha", "check", "n"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = _lines("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("n").cast("string"), "\r\n\r\n")
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    found = found.withColumns({"revisit": again, "block": F.when(again, http).otherwise(F.concat(http, "html"))})
    record = _lines(
        "WARC/1.1\r\nWARC-Type: ", F.when(F.col("revisit"), "revisit").otherwise("response"),
        "\r\nWARC-Record-ID: <urn:page:", _name(F.col("id")), ">\r\nWARC-Target-URI: ", url,
        "\r\nWARC-Date: ", date, "\r\nWARC-Payload-Digest: sha1:", F.col("sha"),
        F.when(F.col("revisit"), _lines("\r\nWARC-Refers-To: <urn:page:", _name(F.col("first")), f">\r\nWARC-Profile: {PROFILE}")).otherwise(""),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", F.octet_length("block").cast("string"),
        "\r\n\r\n", F.col("block"),
    )
    found.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(folder)


class _File:
    """Bytes of a file in the store that its path names."""

    def __init__(self, path: str):
        if path.startswith("file:"):
            where, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            where, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        self.file = where.open_input_file(name)

    def read(self, low: int, high: int) -> bytes:
        return self.file.read_at(high - low, low)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def _candidates(file: _File, size: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each candidate that begins in low:high and ends in the file; end is its successor."""
    while low < high:
        upto, begin = min(low + SLICE, high), max(low - 1, 0)
        data = file.read(begin, min(upto + len(_MAGIC), size))
        found = [0] if low == 0 and data.startswith(_MAGIC) else []
        for place in (*found, *(x.start() + 1 for x in _START.finditer(data))):
            head = _header(file, size, begin, data, place)
            length = head and _LENGTH.search(head)
            end = begin + place + len(head) + int(length[1]) + 4 if length else size + 1
            if end <= size and begin + place < upto:
                yield begin + place, end
        low = upto


def _header(file: _File, size: int, begin: int, data: bytes, place: int) -> bytes | None:
    """The header that begins at this place, if one does; more is read only while it may still be one."""
    more, extent = data[place : place + (64 << 10)], 64 << 10
    while True:
        if found := _HEADER.match(more):
            return found[0]
        if not _OPEN.match(more) or begin + place + len(more) >= size:
            return None
        more = file.read(begin + place, min(begin + place + extent, size))
        extent *= 4


def _chain_exits(starts: np.ndarray, ends: np.ndarray, low: int, high: int, size: int) -> np.ndarray:
    """Where the chain of each candidate leaves the range; below zero where it breaks off inside."""
    at = np.minimum(np.searchsorted(starts, ends), len(starts) - 1)
    inside = starts[at] == ends
    jump = np.where(inside, at, np.arange(len(starts)))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    exits = ends[jump]
    return np.where((exits >= high) | (exits == size), exits, -exits)


def ranges(spark: SparkSession, folder: str, each: int | None = None) -> DataFrame:
    """The candidates of all ranges of the folder's files, a row a range that has some (RANGE)."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size")).where("size > 0")
    total, n_files = files.agg(F.sum("size"), F.count("*")).first()
    each = each or min(max((total or 0) // MANY, SMALLEST_RANGE), LARGEST_RANGE)
    lows = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / each) * each, F.lit(each).cast("long")))
    tasks = files.select("path", "size", lows.alias("low")).repartition(max(1, (total or 0) // each + n_files))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                high = min(row["low"] + each, row["size"])
                with _File(row["path"]) as file:
                    found = np.array(list(_candidates(file, row["size"], row["low"], high)), np.int64).reshape(-1, 2)
                if len(found):
                    exits = _chain_exits(found[:, 0], found[:, 1], row["low"], high, row["size"])
                    lists = [pa.array([x], pa.list_(pa.int64())) for x in (found[:, 0], found[:, 1], exits)]
                    yield pa.RecordBatch.from_arrays([*(pa.array([row[k]]) for k in ("path", "size", "low")), *lists], ["path", "size", "low", "starts", "ends", "exits"])

    return tasks.mapInArrow(look, RANGE).withColumn("each", F.lit(each).cast("long"))


def entered(found: DataFrame) -> DataFrame:
    """(path, low, entry): where the chain from each file's start enters each range; found: stored ``ranges``."""
    starts = found.where("low = 0").select("path", F.lit(0).cast("long").alias("at"))
    exits = found.select("path", "size", F.explode(F.array_distinct("exits")).alias("at")).where("at >= 0 and at < size").select("path", "at")
    nodes = starts.unionByName(exits).distinct().join(found.select("path", "each").distinct(), "path")
    nodes = nodes.withColumn("low", F.col("at") - F.col("at") % F.col("each"))
    inside = nodes.join(found.drop("each", "size"), ["path", "low"])
    to = F.get("exits", F.array_position("starts", F.col("at")).cast("int") - 1)
    links = stored(inside.select("path", "low", "at", to.alias("to")).where("to is not null"))
    reached = stored(links.where("at = 0").select("path", "low", "at"))
    jumps, n, before = links.select("path", "at", "to"), reached.count(), -1
    where = links.select("path", F.col("at").alias("to"), "low")
    while n != before:
        met = reached.select("path", "at").join(jumps, ["path", "at"]).select("path", "to").join(where, ["path", "to"])
        reached = stored(reached.unionByName(met.select("path", "low", F.col("to").alias("at"))).distinct())
        before, n = n, reached.count()
        if n != before:
            after = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("next"))
            jumps = stored(jumps.join(after, ["path", "to"]).select("path", "at", F.col("next").alias("to")))
    return reached.select("path", "low", F.col("at").alias("entry"))


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _record(path: str, offset: int, data: bytes, payloads: bool) -> tuple:
    head = _HEADER.match(data)[0]
    fields, block = _fields(head), data[len(head) : -4]
    payload, n = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = _fields(http).get("content-length", "")
        n = int(said) if said.isdigit() else len(payload)
    own = fields.get("warc-type")
    payload = None if own == "revisit" or not payloads else payload
    names = ("warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest")
    return (path, offset, own, *(fields.get(k) for k in names), n, payload)


def records(spark: SparkSession, folder: str, each: int | None = None, payloads: bool = True) -> DataFrame:
    """The records (RECORD) of a folder's archives that the chain from each file's start reaches.

    A revisit has no payload of its own; ``payload_bytes`` is the length of the
    one it stands for.  Chains that break off end there, see ``coverage``.
    """
    found = stored(ranges(spark, folder, each))
    own = found.join(entered(found), ["path", "low"]).select("path", "entry", "starts", "ends")
    types = pa.schema([("path", pa.string()), ("offset", pa.int64()), *((x, pa.string()) for x in ("warc_type", "record_id", "target_uri", "refers_to", "digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def slices(path: str, spans: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        with _File(path) as file:
            while spans:
                n = 1
                while n < len(spans) and spans[n][1] - spans[0][0] <= SLICE:
                    n += 1
                first, data = spans[0][0], file.read(spans[0][0], spans[n - 1][1])
                rows = [_record(path, a, data[a - first : b - first], payloads) for a, b in spans[:n]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.types)], schema=types)
                spans = spans[n:]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                follow, spans, at = dict(zip(row["starts"], row["ends"])), [], row["entry"]
                while at in follow:
                    spans.append((at, follow[at]))
                    at = follow[at]
                yield from slices(row["path"], spans)

    n = max(1, found.count())
    return own.repartition(n).mapInArrow(read, RECORD)


def coverage(spark: SparkSession, folder: str, each: int | None = None) -> DataFrame:
    """(path, size, read_to, complete): how far the chain from its start goes in each file."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"))
    found = stored(ranges(spark, folder, each))
    own = found.join(entered(found), ["path", "low"])
    last = F.abs(F.get("exits", F.array_position("starts", F.col("entry")).cast("int") - 1))
    reach = own.select("path", last.alias("to")).groupBy("path").agg(F.max("to").alias("read_to"))
    read_to = F.coalesce("read_to", F.lit(0).cast("long"))
    return files.join(reach, "path", "left").select("path", "size", read_to.alias("read_to"), (read_to == F.col("size")).alias("complete"))


def page_of(name: Column) -> Column:
    """The page id, as text, in a record's name; null where it has none."""
    return F.nullif(F.url_decode(F.regexp_extract(name, "^<urn:page:([^>]*)>$", 1)), F.lit(""))


def digest(found: DataFrame, id_type: str = "long") -> DataFrame:
    """Digests of records of pages: of responses from the payload read, of revisits as the header says."""
    own = F.sha1("payload")
    said = F.regexp_replace("digest", "^sha1:", "")
    return found.select(
        page_of(F.col("record_id")).cast(id_type).alias("page_id"), "payload_bytes",
        F.when(F.col("warc_type") == "revisit", said).otherwise(own).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page_of(F.col("refers_to")).cast(id_type).alias("refers_to"),
        F.col("target_uri").alias("url"),
    )
