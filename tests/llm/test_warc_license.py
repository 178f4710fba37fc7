import base64
import gzip
import hashlib
import random
import re
import time

import pyarrow as pa

from tidewater.llm import common, license_scan, warc


def test_loser_tree():
    for seed in range(30):
        rnd = random.Random(seed)
        runs = [sorted(("k%02d" % rnd.randint(0, 20), rnd.randint(0, 3), i * 100 + j, "r") for j in range(rnd.randint(0, 12))) for i in range(rnd.randint(0, 9))]
        assert list(warc.merge_runs(runs)) == sorted(sum(runs, []), key=warc._order)


def test_archives(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "é\r\n\r\nWARC/1.1\r\n", "é\r\n\r\nWARC/1.1\r\n", "x" * 100_000, "\r\n\r\n"]
    rows = [(i, f"http://www.h{i % 2}.Example.com/p?q={i}#f", h, "extra") for i, h in enumerate(html)]
    rows += [(None, None, "<p>a</p>", "e"), (7, "http://z", "\r\n\r\n", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, value string")
    got = warc.archive(pages)
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (h or "") and r[0] is not None]
        keep = max(same) if same else None
        again = i != keep
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", keep if again else None))
    out = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()]
    assert sorted(out, key=str) == sorted(want, key=str)
    keys = [(r.url_key, r.capture_ts) for r in got.collect()]
    assert keys == sorted(keys)
    assert "com,example,h0)/p?q=0" in {k for k, _ in keys}
    assert warc.archive(pages.limit(0)).count() == 0


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive(pages, least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_times_do_not_depend_on_the_session(spark):
    """Captures around the change of clocks keep their time and order in any time zone."""
    ids = [0, 5_000_000, 5_878_800 + 3_599, 5_878_800 + 3_600, 26_438_399, 26_438_400, 26_442_000, 400_000_000]
    pages = spark.createDataFrame([(i, "http://a/b", str(i)) for i in ids], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "UTC", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [(r.page_id, r.capture_ts) for r in warc.archive(pages).collect()]
            assert got == [(i, warc.FIRST_CAPTURE + i) for i in ids]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_archives_are_bounded_and_open_member_by_member(spark, tmp_path):
    rnd = random.Random(3)
    html = ["".join(rnd.choices("abcdefgh ", k=rnd.randint(0, 4000))) for _ in range(300)] + ["y" * 17_000_000]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    warc.write(pages.repartition(2), f"{tmp_path}/w", archive_bytes=50_000)
    files = sorted(tmp_path.glob("w/*.txt"))
    assert len(files) > 5 and all(f.stat().st_size < 55_000 for f in files)
    found = {}
    for f in files:
        whole = gzip.decompress(f.read_bytes())
        parts = list(warc.members(memoryview(f.read_bytes())))
        assert b"".join(parts) == whole and all(p.startswith(b"WARC/1.1") for p in parts if p)
        for head, payload in warc.parse(whole):
            found[head["WARC-Record-ID"]] = payload.decode()
    assert found == {f"<urn:page:{i}>": h for i, h in enumerate(html)}
    assert sorted(r.page_id for r in warc.captures(spark, f"{tmp_path}/w").collect()) == list(range(301))


def test_many_copies_without_a_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "same" if i % 3 else f"p{i // 2}") for i in range(60)], "page_id long, url string, html string")
    want = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archive(pages).collect())
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archive(pages).collect()) == want
    assert [w for w in want if w[1] == "revisit"][0][2] is not None and (59, "response", None) in want


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "CC-BY", "cc by cc by CC,BY!", "xcc by", "cc byx", "écc by", "the GNU General Public License, v3", "All  rights\n\nreserved.",
    "all rights reserve", "All rigths reserved", "Licensed under the Apache Licence, Version 2.0", "lots of words " * 9000 + "cc by",
    "Permission is herby granted, free of charge, to any persn", "İÅ cc  by ߿", "general public license general public license", "allrights reserved", "\x00\x7f",
]


def test_scan(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "cc by", "s")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert got[10].labels == "reserved-notice" and got[10].spans[0].edits in (1, 2)
    assert "apache-2.0" in got[11].labels and "mit" in got[13].labels
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_fuzzy_against_every_window():
    """Seeds lose no match: compare with the regex library over the whole text."""
    rnd, scanner = random.Random(5), license_scan.Scanner()
    for _ in range(150):
        p, (label, k) = rnd.choice(list(license_scan.NOTICES.items()))
        letters = list(p)
        for _ in range(rnd.randint(0, k)):
            at, kind = rnd.randrange(1, len(letters) - 1), rnd.random()
            if kind < 0.4:
                letters[at] = rnd.choice("abcdez")
            elif kind < 0.7:
                del letters[at]
            else:
                letters.insert(at, rnd.choice("abcdez"))
        text = "some words here " * rnd.randint(0, 3) + " ".join("".join(letters).split()) + " and more" * rnd.randint(0, 3)
        i = [x[0] for x in scanner.patterns].index(p, len(license_scan.BASE))
        assert label in scanner.scan(text)["labels"].split(",") or not scanner.regex[i].search(text), text


def test_edits_are_letters_and_places_words():
    scanner = license_scan.Scanner()
    for text, n in (("see é: licensed under the mït licensé ok", 2), ("licensed under the mit license", 0)):
        _, words = next(license_scan.normalised(pa.array([text])))
        spans = [s for s in scanner.scan(words)["spans"] if s[0] == "mit"]
        at = 2 if n else 0
        assert spans == [("mit", at, at + 5, n)]
    _, words = next(license_scan.normalised(pa.array(["SPDX-License-Identifier: GPL-2.0-only"])))
    assert set(scanner.scan(words)["labels"].split(",")) == {"spdx:gpl-2.0", "spdx:gpl-2.0-only"}
    assert len(license_scan.NOTICES) > 100


def test_many_matches_take_linear_time():
    scanner, times = license_scan.Scanner(), []
    for n in (20_000, 80_000):
        text = " ".join(["cc by é all rights reserved"] * n)
        began = time.perf_counter()
        got = scanner.scan(text)
        times.append(time.perf_counter() - began)
        assert (got["n_base"], got["first_word"], got["last_word"]) == (2 * n, 0, 6 * (n - 1) + 3)
    assert times[1] < 8 * times[0] + 0.5


def test_a_seed_that_opens_an_earlier_window():
    """The piece found first may ask for a later window than the next one."""
    scanner = license_scan.Scanner({}, {"abcdefghij klmnopqrst": ("x", 1)})
    text = "zz abcdefghij klmnopqrst"
    assert scanner.scan("abcdefghij " + text)["spans"] and [s[1:] for s in scanner.scan(text)["spans"]] == [(1, 3, 0)]
    assert license_scan.joined([(5, 9), (2, 6), (20, 30), (8, 11)]) == [[2, 11], [20, 30]]
