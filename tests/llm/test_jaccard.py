import random
import re

import pytest

from tidewater.llm import jaccard_join
from tidewater.llm.components import components


def brute(rows, percent=80):
    """doc -> (n_shingles, component), by comparing all pairs."""
    sets = []
    for _, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    names = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        names[r] = min((x for x in (names.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), names[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def made(seed):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)]
    line = " ".join(rnd.choices(vocab, k=12))
    rows, base = [], [" ".join(rnd.choices(vocab, k=rnd.choice([3, 5, 6, 40, 120]))) for _ in range(8)]
    for i in range(70):
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        t = rnd.choice([" ", "\n", "\t\x0b"]).join(w)
        if rnd.random() < 0.4:
            t += "\n" + line
        rows.append((i + 5, t.upper() if rnd.random() < 0.2 else t))
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (400, "A b\tc"), (401, "a\xa0b c"), (None, "a b c"), (4, "a b c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, sid int")
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("block_sets", [256, 7])
def test_all_links_of_a_large_group(spark, block_sets):
    """Near copies with different texts: every similar pair is a link, also of sets connected already."""
    rnd = random.Random(5)
    base = ["w%d" % rnd.randrange(10_000) for _ in range(160)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(1, 3)):
            w[rnd.randrange(160)] = "x%d" % rnd.randrange(10_000)
        rows.append((i, " ".join(w)))
    rows += [(100 + d, t) for d, t in made(1) if d is not None] + [(90, rows[3][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, members = jaccard_join.links(docs, block_sets=block_sets)
    got = [(r.a, r.b, r.common) for r in pairs.collect()]
    sids = {}
    for r in members.collect():
        sids.setdefault(r.sid, []).append(r.doc_id)
    texts, sets = dict(rows), {}
    for sid, ids in sids.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (texts[ids[0]] or "").lower())
        if sid is not None:
            sets[sid] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    want = {(a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a < b and 100 * len(x & y) >= 80 * len(x | y)}
    assert len(want) > 500 and len(got) == len(want) and set(got) == want
    counts = {r.doc_id: r.n_links for r in jaccard_join.link_counts(docs, block_sets=block_sets).collect()}
    assert counts == {d: sum(sid in p[:2] for p in want) for sid, ids in sids.items() for d in ids}


def test_no_links(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.links(docs)[0].count() == jaccard_join.link_counts(docs).count() == 0


def test_links_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(200)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(jaccard_join.LINKS_SQL)
    got = jaccard_join.link_counts(docs)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_components(docs).count() == 0


def test_star_steps(spark):
    chain = [(i, i + 1) for i in range(0, 40, 1) if i != 20] + [(50, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}


def test_one_row_of_each_component(spark):
    """Rows leave by themselves: not by an id, or null, that others have as well."""
    near = " ".join("w%d" % i for i in range(60))
    rows = [(1, near), (None, near + " x"), (None, "a clean text of its own here"), (None, "one more of them all alone"), (None, None)]
    rows += [(7, near + " y"), (7, "an unrelated text under the same id"), (7, ""), (1, near + " z")]
    other = " ".join("v%d" % i for i in range(60))
    rows += [(None, other), (None, other + " x"), (None, other.upper()), (20, "said twice by the same id"), (20, "said twice by the same id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sid int")
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sum((t or "").startswith(near) for _, t in kept) == 1 and any(d == 1 and t in (near, near + " z") for d, t in kept)
    assert sum((t or "").lower().startswith(other) for _, t in kept) == 1
    rest = [r for r in kept if not (r[1] or "").lower().startswith((near, other))]
    assert sorted(rest, key=str) == sorted([rows[2], rows[3], rows[4], rows[6], rows[7], rows[12]], key=str)


def test_very_long_texts_and_a_token_of_most_sets(spark):
    """Whole texts count, and a passage that most documents share links none of them."""
    rnd = random.Random(6)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    near = long[:]
    for k in range(0, 60_000, 900):
        near[k] = "x"
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:40_000]))]
    rows += [(10 + i, " ".join(f"u{i}x{k}" for k in range(9)) + " " + passage) for i in range(150)] + [(500 + i, passage + f" z{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
