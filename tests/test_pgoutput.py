import re
import struct

from tidewater.sources import pgoutput

COLUMNS = [("id", 1), ("name", 0), ("big", 0)]


def told(oid=9):
    return b"R" + struct.pack(">I", oid) + b"public\0things\0f" + struct.pack(">H", 3) + b"".join(bytes([k]) + c.encode() + b"\0" + bytes(8) for c, k in COLUMNS)


def image(*cells):
    out = struct.pack(">H", len(cells))
    for c in cells:
        out += b"n" if c is None else b"u" if c is ... else b"t" + struct.pack(">I", len(c.encode())) + c.encode()
    return out


def begin(lsn):
    return b"B" + struct.pack(">qqI", lsn, 0, 1)


def test_frames(spark):
    oid = struct.pack(">I", 9)
    frames = [
        told(), begin(100), b"I" + oid + b"N" + image("1", "é", None), b"C" + bytes(25),
        begin(200), b"U" + oid + b"O" + image("1", "é", "L") + b"N" + image("1", "b", ...), b"U" + oid + b"N" + image("1", "c", ...),
        b"D" + oid + b"K" + image("1", None, None), b"T" + struct.pack(">IB", 1, 0) + oid, b"M" + bytes(9) + b"ddl\0" + struct.pack(">I", 0), b"I" + struct.pack(">I", 8) + b"N" + image("x"),
    ]
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate(frames)] + [(1, 0, None)], "stream long, seq long, data binary")
    got = [(r.seq, r.lsn, r.op, r.pk, r.new, r.old, r.unchanged) for r in pgoutput.changes(df.repartition(3)).orderBy("seq").collect()]
    assert got == [
        (2, 100, "insert", "1", {"id": "1", "name": "é", "big": None}, None, []),
        (5, 200, "update", "1", {"id": "1", "name": "b", "big": "L"}, {"id": "1", "name": "é", "big": "L"}, []),
        (6, 200, "update", "1", {"id": "1", "name": "c"}, None, ["big"]),
        (7, 200, "delete", "1", None, {"id": "1", "name": None, "big": None}, []),
        (8, 200, "truncate", None, None, None, None),
        (9, 200, "message", None, None, None, None),
    ]


def test_a_table_described_anew(spark):
    """Every frame is read by the description before it, in its own stream; transactions too."""
    oid = struct.pack(">I", 9)
    narrow = b"R" + oid + b"public\0things\0f" + struct.pack(">H", 2) + b"\x01id\0" + bytes(8) + b"\0big\0" + bytes(8)
    put = lambda *cells: b"I" + oid + b"N" + image(*cells)
    both = b"T" + struct.pack(">IB", 2, 0) + oid + struct.pack(">I", 8)
    frames = [told(), begin(1), put("1", "a", "x"), told(), narrow, put("2", "y"), begin(2), put("3", "z"), told(), put("4", "b", "w"), told(8), both]
    rows = [(0, i, f) for i, f in enumerate(frames)] + [(1, 0, put("9", "lost")), (1, 3, told()), (1, 4, begin(7)), (1, 5, put("5", None, "v")), (1, 6, b"")]
    df = spark.createDataFrame(rows, "stream long, seq long, data binary")
    got = [(r.stream, r.seq, r.lsn, r.op, r.pk, r.new) for r in pgoutput.changes(df.repartition(5)).orderBy("stream", "seq").collect()]
    assert got == [
        (0, 2, 1, "insert", "1", {"id": "1", "name": "a", "big": "x"}),
        (0, 5, 1, "insert", "2", {"id": "2", "big": "y"}),
        (0, 7, 2, "insert", "3", {"id": "3", "big": "z"}),
        (0, 9, 2, "insert", "4", {"id": "4", "name": "b", "big": "w"}),
        (0, 11, 2, "truncate", None, None),
        (0, 11, 2, "truncate", None, None),
        (1, 5, 7, "insert", "5", {"id": "5", "name": None, "big": "v"}),
    ]


def test_a_table_described_often(spark):
    """The work for a frame does not grow with the descriptions before it: no join compares places."""
    oid = struct.pack(">I", 9)
    frames, want, names = [], [], []
    for i in range(3000):
        if i % 10 == 0:
            names = ["id", f"c{i}"]
            frames.append(b"R" + oid + b"public\0things\0f" + struct.pack(">H", 2) + b"\x01id\0" + bytes(8) + b"\0" + names[1].encode() + b"\0" + bytes(8))
        if i % 7 == 0:
            frames.append(begin(i))
        want.append((len(frames), i // 7 * 7, str(i), {"id": str(i), names[1]: "v"}))
        frames.append(b"I" + oid + b"N" + image(str(i), "v"))
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate(frames)], "stream long, seq long, data binary")
    out = pgoutput.changes(df.repartition(5))
    assert [(r.seq, r.lsn, r.pk, r.new) for r in out.orderBy("seq").collect()] == want
    assert not [j for j in re.findall(r"Join .*", out._jdf.queryExecution().optimizedPlan().toString()) if ">=" in j]
