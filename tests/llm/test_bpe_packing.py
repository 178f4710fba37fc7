import hashlib
import random
import struct
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import bpe, packing

ODD = ["", " ", "a", "\n\n  x", "it's I'LL 've", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "日本語 テスト", "é́ ÅΣΑΣ ﬁ", "x" * 5000, "\x00\x1c\x1d\x85\xa0　 y", "🙂👍🏽 ok", "1234 5६", "İSTANBUL ẞ", "'S 'Re !!'s ''t", "<|startoftext|>hi <|end", "ͅ͵ﬁẛ̣"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(packing.default_path())


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(), st.text("ab 'stre\n.<|>1", max_size=60)))
def test_same_ids_as_library(library, words, text):
    ids = library.encode(text, add_special_tokens=False).ids
    ours = bpe.tokenizer(bpe.default_path())
    coded = ours.encode(text)
    assert coded == ",".join(map(str, ids))
    assert ours.decode(coded) == library.decode(ids, skip_special_tokens=False)
    ids = words.encode(text, add_special_tokens=False).ids
    assert packing.word_ids(packing.default_path()).encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_odd_texts(spark, library, words):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "a")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect())
    want = []
    for _, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    back = bpe.decode(bpe.encode(docs))
    assert {r.text for r in back.collect()} == {t or "" for _, t in rows}
    got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack_documents(docs).collect())
    want = []
    for _, t in rows:
        ids = [*words.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            p = ids[k : k + 2048]
            want.append((k // 2048, k, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))))
    assert got == sorted(want)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(docs).count() == 0
    assert packing.pack_documents(docs).count() == 0


def best_fit_one_by_one(lengths, size):
    rooms, used = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            used += 1
            rooms.append(size - n)
    return used, sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    size = rnd.choice([7, 64, 200])
    lengths = [rnd.randint(1, rnd.choice([size, max(1, size // 3)])) for _ in range(rnd.randint(1, 400))]
    hist = defaultdict(int)
    for n in lengths:
        hist[n] += 1
    rows, fill = sorted(packing.plan(dict(hist), size)), defaultdict(list)
    for n, count in hist.items():
        own = [r for r in rows if r[0] == n]
        for rank in range(count):
            _, first, seq, each, at = [r for r in own if r[1] <= rank][-1]
            fill[seq + (rank - first) // each].append((at + (rank - first) % each * n, n))
    ends = []
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
        ends.append(size - at)
    assert (len(fill), sorted(ends)) == best_fit_one_by_one(lengths, size)


def test_packed_rows(spark):
    lengths = [2048] * 30 + [700, 699, 650, 5, 5, 5, 1] * 20
    items = spark.createDataFrame([(i if i % 9 else None, i, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    fill = defaultdict(list)
    for r in packing.pack(items).collect():
        fill[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, fill.values())) == len(lengths)
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(fill) == best_fit_one_by_one(lengths, 2048)[0]


def test_packing_with_clashing_columns(spark):
    """Columns named as those of the result pass by; ids of any type, nulls and repeats are packed."""
    texts = ["one two", None, "", "word " * 5_000, "one two", "one two"]
    rows = [(str(i) if i else None, t, 1, 2, 3, 4, 5, 6, 7) for i, t in enumerate(texts)] + [("4", "one two", 1, 2, 3, 4, 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, piece int, start int, length int, sequence_id int, offset int, rank int, part int")
    got = packing.pack_documents(docs).collect()
    pieces = [(r.doc_id, r.piece) for r in got]
    assert len(pieces) == 6 + len([p for p in pieces if p[0] == "3"]) and {p[0] for p in pieces} == {None, "1", "2", "3", "4", "5"}
    assert [r.length for r in got if r.doc_id in ("1", "2")] == [1, 1]
    spots = {}
    for r in got:
        spots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spots.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= packing.SIZE
    assert packing.pack_documents(docs.limit(0)).count() == 0
