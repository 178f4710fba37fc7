"""Logical-replication frames (pgoutput, protocol 1) as change rows.

Frames are a table (stream, seq, data). A table's description (relation frame) holds from
its place until the next one for the table, and a frame's transaction is that of the last
begin frame before it: both are carried forward in order, inside ranges of the stream and
from each range to the next, so the work does not grow with the number of descriptions.
Frames are then decoded each by itself, in Arrow batches on all executors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.numbering import latest

OPS = {b"I": "insert", b"U": "update", b"D": "delete"}
TEXTS = pa.map_(pa.string(), pa.string())
SCHEMA = "stream long, seq long, lsn long, schema string, table string, op string, pk string, new map<string,string>, old map<string,string>, unchanged array<string>"


class Reader:
    """Reads big-endian numbers and zero-ended texts one after the other."""

    def __init__(self, data: bytes, at: int = 1):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("frame ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(">" + kind, self.take(struct.calcsize(kind)))[0]

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out, self.at = self.data[self.at : end].decode(), end + 1
        return out

    def more(self) -> bool:
        return self.at < len(self.data)


def relation(data: bytes) -> tuple[int, tuple[str, str, list[tuple[str, bool]]]]:
    """oid and (schema, table, [(column, is key)]) of a description frame."""
    r = Reader(data)
    oid, schema, table = r.number("I"), r.text(), r.text()
    r.take(1)
    columns = []
    for _ in range(r.number("H")):
        key = r.number("B") & 1
        columns.append((r.text(), bool(key)))
        r.take(8)
    return oid, (schema, table, columns)


def row(r: Reader, columns: list[tuple[str, bool]]) -> tuple[dict[str, str | None], list[str]]:
    """A row image and the names of large values that the frame leaves out."""
    out, left_out = {}, []
    for name, _ in columns[: r.number("H")]:
        kind = r.take(1)
        if kind == b"n":
            out[name] = None
        elif kind == b"u":
            left_out.append(name)
        else:
            out[name] = r.take(r.number("I")).decode()
    return out, left_out


def decode(data: bytes, described: tuple | None) -> list[dict]:
    """The changes of one frame of a table that is ``described`` so (of a truncate of several
    tables: of that table)."""
    kind, r = data[:1], Reader(data)
    if kind == b"M":
        r.take(9)
        return [{"op": "message", "table": r.text()}]
    if described is None:
        return []
    if kind == b"T":
        return [{"schema": described[0], "table": described[1], "op": "truncate"}]
    if kind not in OPS:
        return []
    r.number("I")
    schema, table, columns = described
    new = old = None
    left_out: list[str] = []
    while r.more():
        side = r.take(1)
        image, gap = row(r, columns)
        if side == b"N":
            new, left_out = image, gap
        else:
            old = image
    if new is not None and old is not None:
        new |= {c: old[c] for c in left_out if c in old}
        left_out = [c for c in left_out if c not in old]
    keys = [c for c, is_key in columns if is_key]
    image = new if new is not None else old or {}
    return [{"schema": schema, "table": table, "op": OPS[kind], "pk": ",".join(str(image.get(c)) for c in keys), "new": new, "old": old, "unchanged": left_out}]


def number(data: Column, at: int, width: int) -> Column:
    """The big-endian number of ``width`` bytes at byte ``at`` (from 0)."""
    return F.conv(F.hex(F.substring(data, at + 1, width)), 16, 10).cast("long")


def changes(frames: DataFrame) -> DataFrame:
    """(stream, seq, lsn, schema, table, op, pk, new, old, unchanged) of all frames; null
    and empty frames, and frames of tables without a description, give no row."""
    kind, data = F.substring("data", 1, 1).cast("string"), F.col("data")
    # the tables of a truncate: their number, a byte of flags, then their oids
    several = F.transform(F.sequence(F.lit(1), number(data, 1, 4).cast("int")), lambda k: F.conv(F.hex(F.substring(data, 3 + 4 * k, F.lit(4))), 16, 10).cast("long"))
    oids = F.when(F.col("kind").isin("R", "I", "U", "D"), F.array(number(data, 1, 4))).when((F.col("kind") == "T") & (number(data, 1, 4) > 0), several).when(F.col("kind").isin("B", "M"), F.array(F.lit(None).cast("long")))
    rows = frames.where(F.octet_length("data") > 0).select("stream", "seq", "data", kind.alias("kind")).select("*", F.explode(oids).alias("oid"))
    change = F.col("kind").isin("I", "U", "D", "T", "M")
    rows = rows.select("stream", "seq", "oid", F.when(change, data).alias("data"), F.when(F.col("kind") == "B", number(data, 1, 8)).alias("lsn"), F.when(F.col("kind") == "R", data).alias("described"))
    rows = latest(rows, ["stream"], ["seq"], {"lsn": [], "described": ["oid"]}).where("data is not null").drop("oid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, names = ["stream", "seq", "lsn"], ["schema", "table", "op", "pk", "new", "old", "unchanged"]
        kinds = [pa.string()] * 4 + [TEXTS, TEXTS, pa.list_(pa.string())]
        known: dict[bytes, tuple] = {}
        for b in batches:
            got, at = [], []
            for i, (data, described) in enumerate(zip(b.column("data").to_pylist(), b.column("described").to_pylist(), strict=True)):
                if described is not None and described not in known:
                    known[described] = relation(described)[1]
                for change in decode(data, known.get(described)):
                    got.append(change)
                    at.append(i)
            column = lambda n, k: pa.array([list(v.items()) if isinstance(v := g.get(n), dict) else v for g in got], k)
            spots = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(n).take(spots) for n in place], *map(column, names, kinds)], [*place, *names])

    return rows.mapInArrow(run, SCHEMA)
