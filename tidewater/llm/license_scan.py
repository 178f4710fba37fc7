"""License scans (operator 3): fuzzy search for short notices.

Words are lower-cased runs of letters, digits and other non-ASCII letters; a text
is searched as its words joined by single spaces. A notice may differ from its
pattern by up to k edits (of letters), so of k + 1 pieces of the pattern one at least
occurs unchanged (pigeonhole): the pieces of all notices are found in one exact pass, and
only windows around them are given to the regex library, whose bounded-error
matching verifies the edits and gives the span. The base phrases are notices with
no edits, and so are SPDX identifiers: their only piece is the phrase itself.

Notices are data: ``scan`` takes any table of them. The default ones are those that
licenses ask to be put into a file's head or that open their texts, with one edit for
every fifteen letters and two at least, and, without edits, those that a letter tells
apart: versions, and "SPDX-License-Identifier:" with each of ``SPDX``.

Defined results: a null text is empty: no words, no places; repeated rows are
scanned each for itself; overlapping matches of one notice count once; an empty
table gives an empty result; texts are scanned whole, whatever their length, in time
linear in it and in what is found. Columns besides id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import LOWER, NOT_ALNUM, chunks, text_arrays, texts

#: Phrases that are found exactly, and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of notices, by label (fixed values).
WORDINGS = {
    "apache-2.0": ["licensed under the apache license version 2 0", "apache license version 2 0 january 2004"],
    "mit": ["permission is hereby granted free of charge to any person", "licensed under the mit license", "released under the mit license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose", "licensed under the isc license"],
    "bsd": ["redistribution and use in source and binary forms", "licensed under the bsd license", "use of this source code is governed by a bsd style license"],
    "gpl-notice": ["gnu general public license"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license"],
    "agpl": ["gnu affero general public license"],
    "gfdl": ["gnu free documentation license"],
    "mpl": ["mozilla public license", "subject to the terms of the mozilla public license v 2 0"],
    "epl": ["eclipse public license"],
    "eupl": ["european union public licence"],
    "cddl": ["common development and distribution license"],
    "artistic": ["the artistic license"],
    "boost": ["boost software license version 1 0"],
    "zlib": ["this software is provided as is without any express or implied warranty"],
    "ofl": ["sil open font license"],
    "odbl": ["open database license", "open data commons"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "wtfpl": ["do what the fuck you want to public license"],
    "ms-pl": ["microsoft public license"],
    "python": ["python software foundation license"],
    "ncsa": ["university of illinois ncsa open source license"],
    "cc-notice": ["licensed under cc by", "creative commons attribution", "creative commons license", "licensed under a creative commons"],
    "cc-by-sa": ["creative commons attribution sharealike"],
    "cc-by-nc": ["creative commons attribution noncommercial"],
    "cc-by-nd": ["creative commons attribution noderivatives", "creative commons attribution noderivs"],
    "cc0": ["creative commons zero", "cc0 1 0 universal"],
    "public-domain": ["released into the public domain", "dedicated to the public domain", "placed in the public domain"],
    "reserved-notice": ["all rights reserved"],
    "proprietary": ["proprietary and confidential", "unauthorized copying of this file"],
    "no-reproduction": ["may not be reproduced", "no part of this publication may be reproduced"],
}
#: Words of notices of which a letter more or less is another notice (fixed values).
EXACT = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license v2": "gpl-2.0",
    "gnu general public license v3": "gpl-3.0",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "licensed under the gpl": "gpl-notice",
}
#: Identifiers of the SPDX license list (fixed values).
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause "
    "BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 "
    "CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC "
    "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA "
    "ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
#: A notice of n letters is found with at most n // LETTERS_PER_EDIT edits, or LEAST_EDITS.
LETTERS_PER_EDIT, LEAST_EDITS = 15, 2


def default_notices() -> dict[str, tuple[str, int]]:
    """Words of each notice, its label and how many edits it may have."""
    out = {words: (label, max(LEAST_EDITS, len(words) // LETTERS_PER_EDIT)) for label, own in WORDINGS.items() for words in own}
    out |= {words: (label, 0) for words, label in EXACT.items()}
    for name in SPDX:
        out["spdx license identifier " + " ".join(re.findall("[a-z0-9]+", name.lower()))] = (f"spdx:{name.lower()}", 0)
    return out


NOTICES = default_notices()


class Scanner:
    """Finds base phrases and fuzzy notices in one text at a time."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, tuple[str, int]] = NOTICES):
        self.patterns = [(p, label, 0, True) for p, label in base.items()]
        self.patterns += [(p, label, k, False) for p, (label, k) in notices.items()]
        self.regex = [regex.compile(f"(?e)(?<![^ ])(?:{regex.escape(p, special_only=True)}){{e<={k}}}(?![^ ])") if k else None for p, _, k, _ in self.patterns]
        seeds: dict[str, list] = {}
        for i, (p, _, k, _) in enumerate(self.patterns):
            cuts = [round(j * len(p) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(p[a:b], []).append((i, a))
        self.seeds = ahocorasick.Automaton()
        for seed, users in seeds.items():
            self.seeds.add_word(seed, (len(seed), users))
        self.seeds.make_automaton()

    def spans(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(pattern, start, end, edits) of every place in normalised ``text``."""
        windows: dict[int, list] = {}
        for end, (n, users) in self.seeds.iter(text):
            start = end + 1 - n
            for i, inside in users:
                p, _, k, _ = self.patterns[i]
                if not k:
                    if (not start or text[start - 1] == " ") and (end + 1 == len(text) or text[end + 1] == " "):
                        yield i, start, end + 1, 0
                    continue
                a = max(0, start - inside - k)
                b = min(len(text), start - inside + len(p) + k)
                windows.setdefault(i, []).append((a, b))
        for i, own in windows.items():
            for a, b in joined(own):
                # a letter more on either side, to see the words' ends
                for m in self.regex[i].finditer(text, max(0, a - 1), min(len(text), b + 1)):
                    if (not m.start() or text[m.start() - 1] == " ") and (m.end() == len(text) or text[m.end()] == " "):
                        yield i, m.start(), m.end(), sum(m.fuzzy_counts)

    def scan(self, text: str) -> dict:
        """What is found in normalised ``text``; places are numbers of words from 0."""
        places, base, labels, best, found = 0, set(), set(), 0.0, []
        first = last = None
        seen = list(self.spans(text))
        # the number of a word is that of the spaces before it
        starts, ends = (np.searchsorted(spaces(text), np.array([x[k] for x in seen], np.int64)).tolist() if seen else [] for k in (1, 2))
        for (i, _, _, edits), word, end in zip(seen, starts, ends, strict=True):
            p, label, _, exact = self.patterns[i]
            labels.add(label)
            found.append((label, word, end + 1, edits))
            best = max(best, 1 - edits / len(p))
            if exact:
                places += 1
                base.add(label)
                first = word if first is None else min(first, word)
                last = word if last is None else max(last, word)
        return {"n_base": places, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": best, "spans": sorted(set(found))}


def joined(windows: list[tuple[int, int]]) -> list[list[int]]:
    """Windows that meet are one."""
    out: list[list[int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def spaces(text: str) -> np.ndarray:
    """The places of all spaces."""
    letters = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.flatnonzero(letters == 32)


def normalised(column: pa.Array) -> Iterator[tuple[int, str]]:
    """For each value, the number of its words and its words joined by spaces."""
    data, offsets = text_arrays(column)
    for lo, hi in chunks(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        at = offsets[lo : hi + 1] - offsets[lo]
        word = ~NOT_ALNUM[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[at] = True
        before = np.zeros(len(part), bool)
        before[1:] = word[:-1]
        before[edge[:-1]] = False
        starts = np.cumsum(np.concatenate(([0], word & ~before)))
        counts = starts[at[1:]] - starts[at[:-1]]
        # a space stays where a word precedes it
        keep = word | (before & ~word)
        kept = np.concatenate(([0], np.cumsum(keep)))[at]
        text = np.where(word, part, np.uint8(32))[keep].tobytes()
        for k in range(hi - lo):
            yield int(counts[k]), text[kept[k] : kept[k + 1]].removesuffix(b" ").decode(errors="replace")


SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())]))
COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,edits:int>>"
_loaded: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, tuple[str, int]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts and labels of every row, and spans: each found notice with its
    label, its words [first_word, end_word) and its edits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (*base.items(), *notices.items())
        if key not in _loaded:
            _loaded[key] = Scanner(base, notices)
        scanner = _loaded[key]
        for b in batches:
            found = []
            for n, text in normalised(b.column(1)):
                found.append(scanner.scan(text) | {"n_words": n})
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPAN]
            columns = [pa.array([[dict(zip(("label", "first_word", "end_word", "edits"), s, strict=True)) for s in f[x]] if x == "spans" else f[x] for f in found], t) for x, t in zip(names, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [id_col, *names])

    return texts(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {COLUMNS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
