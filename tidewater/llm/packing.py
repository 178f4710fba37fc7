"""Best-fit packing (operator 7).

Documents become pieces of at most ``size`` tokens; pieces are packed best-fit
decreasing: longest first, each into the open sequence with the least room that
still holds it, found in a segment tree over the remaining capacities. Pieces of
one length are alike and so are sequences with equal room, so the tree's leaves
are counts and runs of sequences, and one step places a whole run of equal pieces:
the plan is made from the histogram of lengths (``size`` rows at most, whatever
the input) and is the same packing that placing pieces one by one gives. Spark
counts the lengths, numbers the pieces of each length (in parts, so that a length
that most pieces have is spread), and looks every piece up in the plan.

Ids are those of the tokenizers library: texts are normalised and cut into words
as its file says, words are encoded by the library's model and kept by each worker in a
table of bounded size; a text that holds a special token's opening, or letters of
less common scripts, goes to the library whole. Defined results: a null or empty text is the end id alone, one
piece of length 1; null ids are kept and ordered first; repeated rows are packed
each for itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewater.llm.bpe import byte_letters
from tidewater.llm.common import stored, texts

#: Tokens of a sequence, and the id that ends a document.
SIZE, END_ID = 2048, 0
#: Pieces of one length that are numbered by one task.
RANK_ROWS = 20_000
#: Words, and runs of them, that a worker keeps: the first ones, frequent words among them.
MEMO_ROWS, MEMO_CHARS = 100_000, 32
#: Letters of other scripts (this is not ASCII, Latin, Greek, Cyrillic or common
#: punctuation): libraries differ in the Unicode version that they know, so texts
#: with such letters go to the tokenizers library whole.
OTHER = r"[^\x00-\u0377\u0400-\u052f\u1e00-\u1eff\u2000-\u2064\u20a0-\u20bf]"
#: The word pattern of the tokenizer file (fixed value).
WORDS = r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\s\p{L}\p{N}]+"
#: Separators that split() takes for white space and the library does not.
SEPARATORS = re.compile("[\x1c-\x1f]").search


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Word to its packed ids; the library's model encodes what is not kept yet."""

    def __init__(self, library):
        self.encode = library.model.tokenize
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        ids = [x.id for x in self.encode(letters)]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= MEMO_CHARS and len(self) < MEMO_ROWS:
            self[word] = packed
        return packed


class _Runs(dict):
    """A run between white space (no word crosses it) to the packed ids of its words."""

    def __init__(self, words: _Words):
        self.split = regex.compile(WORDS).findall
        self.word = words.__getitem__

    def __missing__(self, run: str) -> bytes:
        if run.isalpha():
            packed = self.word(run)
        elif run[:-1].isalpha() and run[-1] in ".,;:!?":
            packed = self.word(run[:-1]) + self.word(run[-1])
        else:
            packed = b"".join(map(self.word, self.split(run)))
        if len(run) <= MEMO_CHARS and len(self) < MEMO_ROWS:
            self[run] = packed
        return packed


class WordIds:
    """Texts to token ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.runs = _Runs(_Words(self.library))
        self.other = regex.compile(OTHER).search

    def encode(self, text: str) -> bytes:
        plain = text.isascii()
        if "<|" in text or not plain and self.other(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if not plain:
            # letter by letter, as the library: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        runs = [text] if SEPARATORS(text) else text.split()
        return b"".join(map(self.runs.__getitem__, runs))


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece."""
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, x in enumerate(b.column(1)):
                ids = words.encode(x.as_py() or "") + tail
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                [id_col, "piece", "start", "length", "ids_crc32"],
            )

    out = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    return texts(docs).select(id_col, text_col).mapInArrow(run, out)


class Rooms:
    """A segment tree over remaining capacities 0..size: which of them have open
    sequences, and the runs (first sequence, count) of each."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.tree = [False] * (2 * self.width)
        self.runs: list[deque] = [deque() for _ in range(size + 1)]

    def _mark(self, room: int, on: bool) -> None:
        at = room + self.width
        while at and self.tree[at] != on:
            self.tree[at] = on
            at //= 2
            on = self.tree[2 * at] or self.tree[2 * at + 1]

    def add(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.runs[room].append((first, count))
            self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].popleft()
        if not self.runs[room]:
            self._mark(room, False)
        return run

    def tightest(self, least: int) -> int | None:
        """The least room of at least ``least`` that has an open sequence."""
        at = least + self.width
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over {length: pieces}: rows (length, first rank, first
    sequence, pieces for each sequence, offset of the first piece in a sequence)."""
    rooms, opened, out = Rooms(size), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, each = size, size // length
                first, count = opened, -(-left // each)
                opened += count
            else:
                each = room // length
                first, count = rooms.take(room)
            placed = min(left, count * each)
            out.append((length, rank, first, each, size - room))
            full, rest = divmod(placed, each)
            rooms.add(room - each * length, first, full)
            if rest:
                rooms.add(room - rest * length, first + full, 1)
            used = full + bool(rest)
            rooms.add(room, first + used, count - used)
            rank, left = rank + placed, left - placed
    return out


def pack(items: DataFrame, size: int = SIZE, id_col: str = "doc_id") -> DataFrame:
    """``items`` (id, piece, length and more) with sequence_id and offset. Lengths
    are from 1 to ``size``; the input is read twice, so pass a stored one."""
    spark = items.sparkSession
    counts = {r.length: r["count"] for r in items.groupBy("length").count().collect()}  # size rows at most
    rows = np.array(sorted(plan(counts, size)), np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(rows)
    parts = spark.createDataFrame([(k, -(-n // RANK_ROWS)) for k, n in counts.items()], "length long, parts long")
    dealt = items.join(F.broadcast(parts), "length").withColumn(
        "part", F.pmod(F.xxhash64(id_col, "piece"), F.col("parts"))
    )
    sums = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sums.select(
        "length",
        "part",
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"),
    )
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy(id_col, "piece")) - 1
    ranked = dealt.withColumn("rank", local).join(before, ["length", "part"])
    ranked = ranked.select(*items.columns, (F.col("rank") + F.col("before")).alias("rank"))
    bits = 44
    out = StructType([*items.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    at_length, at_rank = items.columns.index("length"), len(items.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        keys = (table[:, 0] << bits) + table[:, 1]
        for b in batches:
            length = b.column(at_length).to_numpy(zero_copy_only=False)
            rank = b.column(at_rank).to_numpy(zero_copy_only=False)
            step = table[np.searchsorted(keys, (length << bits) + rank, "right") - 1]
            nth = rank - step[:, 1]
            columns = [pa.array(step[:, 2] + nth // step[:, 3]), pa.array(step[:, 4] + nth % step[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at_rank], *columns], names=out.names)

    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(stored(pieces(docs, path, size, END_ID, id_col, text_col), "pieces"), size, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
