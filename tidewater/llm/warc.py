"""WARC archives and their capture index (operator 10).

Writing: a record for every page, each a gzip member of its own, in files of about
``ARCHIVE_BYTES`` that Spark's text writer writes and commits (and names part-*.txt; what
is in them are .warc.gz archives). Of records with equal payloads of at least
``least_bytes`` bytes the one with the largest id is a response; the others are revisits
that refer to it and carry no payload. Payloads pass no exchange unless more of them
repeat than can be broadcast. Reading: an archive's members are decompressed one after
the other and cut by Content-Length, so a task holds an archive and one record, of
ARCHIVE_BYTES or the largest record's size.

Index: every archive gives a run of captures sorted by URL key and time. Ranges of
(URL key, time, id) go to one task each, in which the sorted pieces of the runs
are merged by a loser tree; the ranges in order are the global capture history.
Ranges hold about ``RANGE_ROWS`` captures, and one URL with many captures is split
over ranges by time, so what a task holds is bounded.

Defined results: a null html is an empty payload, a null url an empty key; pages
with a null id are written without an id, count as the smallest id and never are
referred to while another copy has one; rows that repeat an id and a payload are
responses all of them when they have the largest id; an empty table gives no
archives and an empty result. Columns besides id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import new_path, small, stored, texts, with_groups

#: Payloads from this size on are written once.
LEAST_BYTES = 0
#: Compressed bytes from which on an archive is closed, and captures of one range of the index.
ARCHIVE_BYTES, RANGE_ROWS = 32 << 20, 50_000
#: Seconds since 1970 of the capture of page 0; page n is captured n seconds later.
FIRST_CAPTURE = 1_577_836_800
END = "\r\n\r\n"

CAPTURE = "url_key string, capture_ts long, page_id long, run string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def url_key(url):
    """The sort key of a URL: host labels reversed, then the path; scheme, "www.",
    port 80/443 and fragment left out; lower case."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://(www\.)?|#.*$", ""))
    host = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r":(80|443)$", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def utc_date(seconds):
    """Seconds since 1970 as a date of WARC, whatever the session's time zone."""
    two = lambda unit, of: F.lpad((F.floor(seconds / unit) % of).cast("string"), 2, "0")
    day = F.date_format(F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")), "yyyy-MM-dd")
    return F.concat(day, F.lit("T"), two(3_600, 24), F.lit(":"), two(60, 60), F.lit(":"), two(1, 60), F.lit("Z"))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One row (value) for each page: its WARC record."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "").alias("url"),
        html.alias("html"),
        F.unhex(F.sha1(html)).alias("sha1"),
        F.octet_length(html).cast("long").alias("bytes"),
    )
    keys = stored(rows.select("page_id", "sha1"), "payloads")
    groups = keys.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
    groups = stored(groups, "copies")
    few = small(groups)
    if few is None:
        rows = rows.withColumns({"last": F.lit(None).cast("long"), "copies": F.lit(None).cast("long")})
    elif few is not groups:
        rows = rows.join(few, "sha1", "left")
    else:
        rows = with_groups(rows, groups, "sha1", "copies", keys.count(), "left")
    rows = rows.withColumn("last", F.when(F.col("copies").isNull(), F.col("page_id")).otherwise(F.col("last")))
    again = (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("last"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), utc_date(F.coalesce(F.col("page_id"), F.lit(0)) + FIRST_CAPTURE)),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Capture-Key: "), F.regexp_replace(url_key(F.col("url")), r"\s", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("last").cast("string"), F.lit(">"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, "0").otherwise(F.col("bytes").cast("string"))),
    ]
    head = F.concat_ws("\r\n", *lines)
    return rows.select(F.concat(head, F.lit(END), F.when(again, "").otherwise(F.col("html")), F.lit(END)).alias("value"))


def base32(digest):
    """Base-32 text of a 20-byte digest: five bytes at a time give eight letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(4):
        number = F.conv(F.hex(F.substring(digest, 5 * k + 1, 5)), 16, 10).cast("long")
        for shift in range(35, -1, -5):
            place = F.shiftright(number, shift).bitwiseAND(F.lit(31)).cast("int") + 1
            out.append(F.substring(letters, place, F.lit(1)))
    return F.concat(*out)


#: A gzip member of no bytes.
NOTHING = zlib.compress(b"", 9, 31)


def member(record: bytes) -> bytes:
    """``record`` as a gzip member whose last byte is 0: it is the high byte of the length,
    and a record of 16 MB or more is followed by a member of no bytes."""
    data = zlib.compress(record, 6, 31)
    return data if data[-1] == 0 else data + NOTHING


def archives(values: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(value) of archives: the members of records, closed when they reach ``archive_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for b in batches:
            for value in b.column(0):
                block.append(member(value.as_buffer()))
                size += len(block[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(block)], pa.binary())], ["value"])
                    block, size = [], 0
        if block:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(block)], pa.binary())], ["value"])

    return texts(values).select("value").mapInArrow(run, "value binary")


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the archives under ``path``: each is a row, whose last byte is the line's end."""
    blocks = archives(records(pages, least_bytes), archive_bytes)
    last = F.octet_length("value") - 1
    (
        blocks.select(F.substring(F.col("value"), F.lit(1), last).cast("string").alias("value"))
        .write.option("lineSep", "\0")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def members(data: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The uncompressed gzip members of ``data``, one at a time."""
    at = 0
    while at < len(data):
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof:
            if at >= len(data):
                raise ValueError("archive ends early")
            parts.append(reader.decompress(data[at : at + step]))
            at += min(step, len(data) - at)
        at -= len(reader.unused_data)
        yield b"".join(parts)


HEAD = re.compile(rb"([A-Za-z-]+): ?([^\r]*)\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = {k.decode(): v.decode() for k, v in HEAD.findall(data, data.index(b"\r\n", at) + 2, end + 2)}
        start = end + 4
        at = start + int(head["Content-Length"])
        yield head, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record not closed at byte {at}")
        at += 4


def _number(urn: str | None) -> int | None:
    digits = urn[len("<urn:page:") : -1] if urn else ""
    return int(digits) if digits else None


def _seconds(date: str) -> int:
    import datetime

    return int(datetime.datetime.fromisoformat(date.replace("Z", "+00:00")).timestamp())


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Read the archives under ``path``; a sorted run of captures from each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                archive = name.as_py().rsplit("/", 1)[-1]
                rows = []
                for head, payload in (r for part in members(memoryview(content.as_buffer())) for r in parse(part)):
                    kind = head["WARC-Type"]
                    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        n, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if found != told:
                            raise ValueError(f"{archive}: digest of {head['WARC-Record-ID']} differs")
                    else:
                        n, found = int(head["WARC-Payload-Length"]), told
                    rows.append((head["WARC-Capture-Key"], _seconds(head["WARC-Date"]), _number(head["WARC-Record-ID"]), archive, kind, n, found, _number(head.get("WARC-Refers-To"))))
                rows.sort(key=_order)
                yield _batch(rows)

    return files.mapInArrow(run, CAPTURE)


_NAMES = [x.split(" ")[0] for x in CAPTURE.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64()}[x.split(" ")[1]] for x in CAPTURE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2]


def merge_runs(runs: list[list], order=_order) -> Iterator:
    """k-way merge of sorted runs by a loser tree: each inner node keeps the run that
    lost there, so the next row costs one comparison on each level."""
    k = len(runs)
    if k == 1:
        yield from runs[0]
    if k < 2:
        return
    places = [iter(r) for r in runs]
    rows = [next(p, None) for p in places]
    keys = [None if r is None else (order(r), i) for i, r in enumerate(rows)]
    less = lambda a, b: keys[b] is None or (keys[a] is not None and keys[a] < keys[b])
    tree = [-1] * k  # tree[0]: the winner
    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if less(a, b) else (b, a)
    tree[0] = winners[1]
    while keys[tree[0]] is not None:
        at = tree[0]
        yield rows[at]
        rows[at] = next(places[at], None)
        keys[at] = None if rows[at] is None else (order(rows[at]), at)
        node = (at + k) // 2
        while node:
            if less(tree[node], at):
                tree[node], at = at, tree[node]
            node //= 2
        tree[0] = at


def history(runs: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The capture history: ``runs`` in global order of (url_key, capture_ts, page_id),
    with place (partition, row) of each. ``rows``: how many captures there are about."""
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // range_rows))
    dealt = runs.repartitionByRange(ranges, "url_key", "capture_ts", "page_id").sortWithinPartitions("run", "url_key", "capture_ts", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.setdefault(row[3], []).append(row)
        block = []
        for row in merge_runs(list(parts.values())):
            block.append(row)
            if len(block) == 10_000:
                yield _batch(block)
                block = []
        if block:
            yield _batch(block)

    return dealt.mapInArrow(run, CAPTURE)


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives of ``pages``, read them back and give the capture history."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path, least_bytes, archive_bytes)
    runs = stored(captures(spark, path), "capture-runs")
    return history(runs, runs.count())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (10 * (i // 8) + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31), 1) FOR i IN range(32)], '') AS payload_digest
  FROM p
)
SELECT page_id, strlen(html) AS payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""
