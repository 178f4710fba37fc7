"""BPE encoding and decoding (operator 1).

A text is cut at special tokens, then into pre-tokens; each pre-token is encoded
by a priority queue of merge ranks over a doubly linked list of symbols, where an
entry whose pair has changed meanwhile is skipped when it is popped. Decoding
concatenates the vocabulary's strings. Words repeat, so each worker keeps the ids
of short pre-tokens in a table of bounded size; this changes no result.

Defined results: a null text is encoded as the empty text (no ids); ids are
returned as null when null; repeated rows are encoded each for itself; an empty
table gives an empty result. Texts are handled whole, whatever their length: a
pre-token of n bytes takes O(n log n) steps. Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import texts

#: The pre-token pattern that the byte-level vocabulary is made for (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept by a worker, and the length of the longest one that is kept.
MEMO_ROWS, MEMO_CHARS = 300_000, 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    bytes stand for themselves, the others for the letters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class Merges:
    """Encodes lists of symbol ids by ranked merges."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.size = max(vocab.values()) + 1
        self.pairs = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a] * self.size + vocab[b]] = (rank, vocab[a + b])

    def encode(self, ids: list[int]) -> list[int]:
        n, size, pairs = len(ids), self.size, self.pairs
        if n < 2:
            return ids
        queue = []
        for i in range(n - 1):
            key = ids[i] * size + ids[i + 1]
            if (found := pairs.get(key)) is not None:
                queue.append((found[0], i, key, found[1]))
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, i, key, made = heapq.heappop(queue)
            j = after[i]
            if j >= n or ids[i] < 0 or ids[i] * size + ids[j] != key:
                continue  # stale: one of the two symbols has been merged away
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := pairs.get(key := made * size + ids[k])) is not None:
                    heapq.heappush(queue, (found[0], i, key, found[1]))
            h = before[i]
            if h >= 0 and (found := pairs.get(key := ids[h] * size + made)) is not None:
                heapq.heappush(queue, (found[0], h, key, found[1]))
        return [x for x in ids if x >= 0]


class _Memo(dict):
    """Pre-token to its ids in decimal, joined by commas; short ones are kept."""

    def __init__(self, merges: Merges, byte_ids: list[int]):
        self.merges, self.byte_ids = merges, byte_ids

    def __missing__(self, piece: str) -> str:
        ids = self.merges.encode([self.byte_ids[b] for b in piece.encode()])
        text = ",".join(map(str, ids))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ROWS:
                self.clear()
            self[piece] = text
        return text


class ByteBpe:
    """A byte-level BPE tokenizer from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.memo = _Memo(Merges(vocab, spec["model"]["merges"]), [vocab[x] for x in letters])
        self.special = {x["content"]: str(x["id"]) for x in spec.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.split = regex.compile(PATTERN).findall
        as_byte = {x: b for b, x in enumerate(letters)}
        self.strings = {str(i): bytes(as_byte[c] for c in s) for s, i in vocab.items()}
        self.strings.update({i: s.encode() for s, i in self.special.items()})

    def encode(self, text: str) -> str:
        """The decimal ids, joined by commas."""
        get = self.memo.__getitem__
        if not any(x in text for x in self.special):
            return ",".join(map(get, self.split(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(map(get, self.split(part)))
        return ",".join(out)

    def decode(self, ids: str) -> str:
        """The text of such ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of every row."""
    return _each(docs, path, id_col, text_col, "ids array<int>", lambda t, text: [int(x) for x in t.encode(text).split(",") if x], pa.list_(pa.int32()))


def decode(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; null ids give null."""
    path = path or default_path()
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            texts = [None if x is None else bpe.decode(",".join(map(str, x))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def _each(docs, path, id_col, text_col, column, one, arrow):
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()
    name = column.split(" ")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            out = [one(bpe, x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, arrow)], [id_col, name])

    return texts(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {column}")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids again: id, n_tokens, and the digests of
    the ids (decimal, joined by commas) and of the decoded text."""
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            counts, coded, decoded = [], [], []
            for x in b.column(1):
                ids = bpe.encode(x.as_py() or "")
                counts.append(ids.count(",") + 1 if ids else 0)
                coded.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts(docs).select(id_col, text_col).mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
