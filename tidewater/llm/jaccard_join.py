"""N-gram Jaccard join (operator 5) by multiple global orders.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Two sets
with a Jaccard similarity of t or more share a token among the first
n - ceil(t n) + 1 tokens of each, under *every* total order of all tokens. So:

1. Shingles are counted in hashed cells over all documents; cells that stand out
   come last in the coarse order (frequency class of the cell, hash). Any order is
   valid, so this choice costs or saves work and never changes the result.
2. Prefixes under the coarse order find the active sets. They are longer by l tokens
   (a tenth of the set and one), so two similar sets share at least the smaller l of
   the two; a set is active if so many of its prefix tokens occur in different sets.
   Tokens of cells that stand out count as such, and are not sent: what is frequent is
   no bucket. Sets that are not active have no link.
3. Among active sets tokens are counted exactly, but for those of cells that stand out:
   they come last by their class. Tokens of one set alone come first and join with
   nothing; the others follow in two orders: (count, hash) and (count, another hash).
4. Candidates share a prefix token under the first order where their lengths and the
   token's places leave room for enough common tokens; only those that also share a
   prefix token under the second order are verified, by the exact intersection.
5. First each bucket of the first order is compared with its pivot, the set with the
   fewest tokens of its own. Sets that are connected so need no comparison with each
   other: what remains are pairs of different components, again from all buckets.
   The links that are left out lie within components, so components are exact.
6. links() gives all similar pairs: as components are exact, every link lies in one.
   The sets of a component are dealt into blocks and every two blocks are compared by
   counting common tokens, each pair of sets once; no pair is left out.

Documents with equal sets are one node. No list of partners is cut and no bucket is
gathered into one row or task: tokens that a large share of all documents has are in cells
that stand out; the few prefix tokens, roots and nodes with a large share of all rows meet
their group's row by broadcast, and pairs meet their sets in sort-merge joins
whose skewed parts Spark splits. In a bucket of many components the pairs that step 5
looks at are those whose lengths, places and second order leave room for a link. Only tables whose size is fixed by a parameter
(cells, a bitmap of active sets) reach the driver.

Defined results: a null text is empty; a document without words has 0 shingles and
is its own component; one with fewer than five words has one shingle, all its words;
repeated rows are nodes with equal sets; a null id is ignored when the smallest id is
taken; an empty table gives an empty result. Columns besides id and text are not read.
Sets and tokens are told apart by 64-bit hashes: of a billion different sets two
have the same hash with a probability of 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import SPACE, chunks, lowered, mix, stored, text_arrays, texts, with_groups, without, word_hashes
from tidewater.llm.components import components

#: Words of a shingle and least similarity in percent.
WORDS, PERCENT = 5, 80
#: 2**CELL_BITS cells count shingles; 2**MAP_BITS bits tell which sets may be active.
CELL_BITS, MAP_BITS = 19, 23
#: The count from which on frequent tokens are taken to have theirs.
FREQUENT = 1 << 40
#: Sets that one task remembers so as not to send copies.
SEEN = 200_000
#: Sets of a component that are compared at a time, and distinct tokens that are counted at a time.
BLOCK_SETS, BLOCK_TOKENS = 256, 4_096
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each value."""
    data, offsets = text_arrays(column)
    for lo, hi in chunks(offsets):
        part = lowered(data[offsets[lo] : offsets[hi]])
        hashes, first, _ = word_hashes(part, offsets[lo : hi + 1] - offsets[lo], SPACE)
        total = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            total += hashes[k : k + len(total)] * _ODD[k % 8] * np.uint64(2 * (k // 8) + 1)
        total = mix(total)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= words:
                yield np.unique(total[a : b - words + 1])
            elif b > a:
                own = hashes[a:b] * _ODD[: b - a]
                yield mix(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield total[:0]


def set_id(tokens: np.ndarray) -> int:
    return int(mix(mix(tokens ^ _ODD[7]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


def longer(n: int) -> int:
    """By how many tokens the coarse prefix is longer than needed for one in common, plus 1."""
    return n // 10 + 1


def coarse_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + longer(n))


def least_common(n: int, percent: int) -> int:
    """Coarse prefix tokens in common with any similar set: one with t n tokens at least."""
    return longer(-(-percent * n // 100))


class _Bits:
    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens >> self.shift).astype(np.int64)


def summaries(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """A row (id, h, n, sid) for every document, h the hash of its text, and rows (cell, seen) for the cells that
    stand out in a task's part of the documents."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, bits = np.zeros(1 << CELL_BITS, np.int64), _Bits(CELL_BITS)
        kind_of_id = None
        for b in batches:
            kind_of_id = b.column(0).type
            n, sid, wait = [], [], []
            for s in shingle_sets(b.column(1), words):
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                wait.append(s)
                if len(wait) == 512:
                    cells += np.bincount(bits.of(np.concatenate(wait)), minlength=len(cells))
                    wait = []
            if wait:
                cells += np.bincount(bits.of(np.concatenate(wait)), minlength=len(cells))
            rows = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())], ["id", "h", "n", "sid", "cell", "seen"])
        if kind_of_id is not None:
            out = np.flatnonzero(cells > max(8, 4 * cells.mean()))
            rows = len(out)
            yield pa.RecordBatch.from_arrays([pa.nulls(rows, kind_of_id), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.array(out.astype(np.int32)), pa.array(cells[out])], ["id", "h", "n", "sid", "cell", "seen"])

    return texts(docs).select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, f"id {kind}, h long, n long, sid long, cell int, seen long")


def frequency_classes(summary: DataFrame) -> np.ndarray:
    """The class of every cell: 0, or 1 + log2 of how often it was seen where it stood out."""
    rows = summary.where("cell is not null").groupBy("cell").agg(F.sum("seen").alias("seen")).collect()  # 2**CELL_BITS at most
    classes = np.zeros(1 << CELL_BITS, np.uint8)
    for r in rows:
        classes[r.cell] = 1 + int(r.seen).bit_length()
    return classes


def coarse_prefixes(docs: DataFrame, classes: np.ndarray, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(token, sid, least) of the prefix tokens of every set under the coarse order that
    are in no frequent cell, and how many of them other sets must have."""
    held = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits, done = held.value, _Bits(CELL_BITS), set()
        for b in batches:
            tokens, sids, least = [], [], []
            for s in shingle_sets(b.column(1), words):
                if not len(s) or (sid := set_id(s)) in done:
                    continue
                if len(done) < SEEN:
                    done.add(sid)
                own = table[bits.of(s)]
                spots = np.argsort(own, kind="stable")[: coarse_length(len(s), percent)]
                rare = spots[own[spots] == 0]
                need = least_common(len(s), percent) - len(spots) + len(rare)
                # a set that needs no further token is active: one row tells
                tokens.append(s[rare] if need > 0 else np.array([sid & (2**64 - 1)], np.uint64))
                sids.append(sid)
                least.append(max(0, need))
                if len(sids) == 512:
                    yield _posts(tokens, sids, least)
                    tokens, sids, least = [], [], []
            if sids:
                yield _posts(tokens, sids, least)

    return texts(docs).select(id_col, text_col).mapInArrow(run, "token long, sid long, least int")


def _posts(tokens: list, sids: list, least: list) -> pa.RecordBatch:
    each = [len(t) for t in tokens]
    columns = [np.concatenate(tokens).view(np.int64), np.repeat(np.array(sids, np.int64), each), np.repeat(np.array(least, np.int32), each)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "sid", "least"])


def sets_of(docs: DataFrame, active: DataFrame, classes: np.ndarray, words: int, id_col: str, text_col: str) -> DataFrame:
    """(sid, n, tokens, classes) of every active set, with each token's class. A bitmap of fixed size spares the sets
    that are certainly not active the way to the exact join."""
    spot = f"shiftrightunsigned(sid, {64 - MAP_BITS})"
    marks = (
        active.groupBy(F.expr(f"cast({spot} >> 5 as int)").alias("at"))
        .agg(F.expr(f"bit_or(shiftleft(1L, cast({spot} & 31 as int)))").alias("bits"))
        .collect()  # 2**(MAP_BITS - 5) rows at most
    )
    bitmap = np.zeros(1 << (MAP_BITS - 5), np.int64)
    for r in marks:
        bitmap[r["at"]] = r["bits"]
    held = docs.sparkSession.sparkContext.broadcast((bitmap, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, table), cell, done = held.value, _Bits(CELL_BITS), set()
        for b in batches:
            sids, sets = [], []
            for s in shingle_sets(b.column(1), words):
                if not len(s) or (sid := set_id(s)) in done:
                    continue
                at = (sid & (2**64 - 1)) >> (64 - MAP_BITS)
                if not bits[at >> 5] >> (at & 31) & 1:
                    continue
                if len(done) < SEEN:
                    done.add(sid)
                sids.append(sid)
                sets.append(s.view(np.int64))
            if sids:
                places, tokens = np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets)
                lists = [pa.ListArray.from_arrays(pa.array(places), pa.array(x)) for x in (tokens, table[cell.of(tokens.view(np.uint64))].astype(np.int8))]
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(np.diff(places).astype(np.int64)), *lists], ["sid", "n", "tokens", "classes"])

    sent = texts(docs).select(id_col, text_col).mapInArrow(run, "sid long, n long, tokens array<long>, classes array<byte>")
    return sent.join(active, "sid", "left_semi").dropDuplicates(["sid"])


def both_orders(sets: DataFrame, percent: int) -> DataFrame:
    """(sid, n, own, first, second) of active sets: own tokens, i.e. those that no
    other active set has, and the shared tokens of the prefix in either order."""
    rows = sets.select("sid", "n", F.explode(F.arrays_zip("tokens", "classes")).alias("t"))
    rows = rows.select("sid", "n", F.col("t.tokens").alias("token"), F.col("t.classes").alias("class"))
    rare = rows.where(F.col("class") == 0).select("sid", "n", "token", F.count("*").over(Window.partitionBy("token")).alias("df")).where("df > 1")
    frequent = rows.where(F.col("class") > 0).select("sid", "n", "token", (F.col("class") + F.lit(FREQUENT)).alias("df"))
    shared = rare.union(frequent)
    grouped = shared.groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("x"))
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    own = F.col("n") - F.size("x")
    length = F.greatest(F.lit(0), keep - own).cast("int")
    return (
        grouped.withColumns({"own": own, "length": length})
        .where("length > 0")
        .select(
            "sid",
            "n",
            "own",
            F.expr("transform(slice(x, 1, length), e -> e.token)").alias("first"),
            F.expr("slice(transform(array_sort(transform(x, e -> struct(e.df, xxhash64(e.token), e.token))), e -> e.token), 1, length)").alias("second"),
        )
    )


def needed(a: Column, b: Column, percent: int) -> Column:
    """Common tokens that sets of a and b tokens need."""
    return F.ceil((a + b) * percent / (100 + percent))


def may_link(n: str, pos: str, m: str, at: str, percent: int) -> Column:
    """Whether two sets of n and m tokens may have enough in common when the first one
    that they share is at place pos of one and at place at of the other."""
    room = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at))
    return room >= needed(F.col(n), F.col(m), percent)


def linked(pairs: DataFrame, orders: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: first those that share a prefix token
    under the second order too, of these the ones with enough common tokens."""
    second = orders.select("sid", "second")
    for side in ("a", "b"):
        pairs = pairs.join(second.toDF(side, f"second_{side}"), side)
    pairs = pairs.where(F.arrays_overlap("second_a", "second_b")).select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select("sid", "n", "tokens").toDF(side, f"n_{side}", f"tokens_{side}"), side)
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return pairs.where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).select("a", "b")


def set_components(docs: DataFrame, summary: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the sets that have links, and (sid, n, tokens, classes) of these and other active sets."""
    classes = frequency_classes(summary)
    coarse = coarse_prefixes(docs, classes, words, percent, id_col, text_col)
    active = stored(active_sets(coarse), "active")
    sets = stored(sets_of(docs, active, classes, words, id_col, text_col), "sets")
    orders = stored(both_orders(sets, percent), "orders")
    posts = orders.select("sid", "n", "own", F.posexplode("first").alias("i", "token")).select("token", "sid", "n", "own", (F.col("own") + F.col("i")).alias("pos"))
    posts = stored(posts, "posts")

    total = posts.count()
    pivot = posts.groupBy("token").agg(F.min(F.struct("own", "sid", "n", "pos")).alias("p"), F.count("*").alias("rows")).where("rows > 1")
    pivot = stored(pivot.select("token", F.col("p.sid").alias("y_sid"), F.col("p.n").alias("y_n"), F.col("p.pos").alias("y_pos"), "rows"), "pivots")
    near = with_groups(posts, pivot, "token", "rows", total).where((F.col("sid") != F.col("y_sid")) & may_link("n", "pos", "y_n", "y_pos", percent))
    tried = stored(near.select(F.least("sid", "y_sid").alias("a"), F.greatest("sid", "y_sid").alias("b")).distinct(), "pivot-pairs")
    edges = stored(linked(tried, orders, sets, percent), "pivot-links")
    roots = stored(components(edges), "roots")

    placed = posts.join(roots.toDF("sid", "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    sizes = placed.groupBy("token", "root").agg(F.count("*").alias("rows"))
    split = sizes.groupBy("token").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.sum("rows").alias("rows"), F.count("*").alias("roots")).where("roots > 1")
    split = stored(split.select("token", "main", "rows"), "split")
    mixed = stored(with_groups(placed, split, "token", "rows", total).drop("rows"), "mixed")
    rest = mixed.where("root <> main").select("token", *[F.col(c).alias(f"x_{c}") for c in ("sid", "n", "pos", "root")])
    cross = rest.join(mixed, "token").where(
        (F.col("x_root") != F.col("root"))
        & ((F.col("root") == F.col("main")) | (F.col("x_sid") < F.col("sid")))
        & may_link("x_n", "x_pos", "n", "pos", percent)
    )
    cross = cross.select(F.least("x_sid", "sid").alias("a"), F.greatest("x_sid", "sid").alias("b")).distinct()
    more = stored(linked(cross.join(tried, ["a", "b"], "left_anti"), orders, sets, percent), "cross-links")
    return components(roots.toDF("a", "b").union(more)), sets


def active_sets(coarse: DataFrame) -> DataFrame:
    """The sets with enough coarse prefix tokens that different sets have as well."""
    by = Window.partitionBy("token").orderBy("sid")
    other = (F.lag("sid").over(by) != F.col("sid")) | (F.lead("sid").over(by) != F.col("sid")) | (F.col("least") == 0)
    # several tasks may have sent a set: it is counted once for a token
    tokens = coarse.withColumn("other", other).where("other").groupBy("token", "sid").agg(F.first("least").alias("least"))
    return tokens.groupBy("sid").agg(F.count("*").alias("n"), F.first("least").alias("least")).where("n >= least").select("sid")


def pairs_within(roots: DataFrame, sets: DataFrame, percent: int, block_sets: int, count: bool) -> DataFrame:
    """All similar pairs of sets of one component: (a, b, common) with a < b, or with
    ``count`` for every two blocks (sid, n_links), where no row is made for a pair."""

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        sid, block, n = (rows[c].to_numpy() for c in ("sid", "block", "n"))
        tokens = np.concatenate([c.flatten().to_numpy() for c in rows["tokens"].chunks])
        distinct, code = np.unique(tokens, return_inverse=True)
        order = np.argsort(code, kind="stable")
        code, row = code[order], np.repeat(np.arange(len(n)), n)[order]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        common = np.zeros((len(left), len(right)), np.int64)
        for lo in range(0, len(distinct), BLOCK_TOKENS):
            at = slice(*np.searchsorted(code, [lo, lo + BLOCK_TOKENS]))
            has = np.zeros((len(n), min(BLOCK_TOKENS, len(distinct) - lo)), np.float32)
            has[row[at], code[at] - lo] = 1
            common += (has[left] @ has[right].T).astype(np.int64)
        similar = common * 100 >= (n[left][:, None] + n[right][None, :] - common) * percent
        if i == j:
            similar &= sid[left][:, None] < sid[right][None, :]
        if count:
            links = np.zeros(len(n), np.int64)
            links[left] += similar.sum(1)
            links[right] += similar.sum(0)
            return pa.table({"sid": sid[links > 0], "n_links": links[links > 0]})
        x, y = np.nonzero(similar)
        one, other = sid[left[x]], sid[right[y]]
        return pa.table({"a": np.minimum(one, other), "b": np.maximum(one, other), "common": common[x, y]})

    own = sets.drop("classes").join(roots.toDF("sid", "root"), "sid")
    large = roots.groupBy("root").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("blocks")).where("blocks > 1")
    own = own.join(F.broadcast(large), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # large: a row for block_sets sets at most
    own = own.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    own = own.select("root", "sid", "n", "tokens", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    own = own.select("root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "sid", "n", "tokens", "block")
    return own.groupBy("root", "i", "j").applyInArrow(compare, "sid long, n_links long" if count else "a long, b long, common long")


def _named(rows: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """id, n_shingles, component_id and sid of every row (id, n, sid)."""
    full = rows.where("n > 0").join(roots.toDF("sid", "root"), "sid", "left").select("id", "n", "sid", F.coalesce("root", "sid").alias("root"))
    full = stored(full, "nodes")
    names = stored(full.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("rows")), "names")
    full = with_groups(full, names, "root", "rows", full.count()).select("id", "n", "component_id", "sid")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "sid")
    return full.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "sid")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row."""
    summary = stored(summaries(docs, words, id_col, text_col), "summaries")
    roots, _ = set_components(docs, summary, words, percent, id_col, text_col)
    return _named(summary.where("n is not null").select("id", "n", "sid"), roots, id_col).drop("sid")


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block_sets: int = BLOCK_SETS) -> tuple[DataFrame, DataFrame]:
    """All similar pairs of different sets as (a, b, common), a < b, and the members:
    id, n_shingles, component_id and sid of every row (sid is null without words)."""
    summary = stored(summaries(docs, words, id_col, text_col), "summaries")
    roots, sets = set_components(docs, summary, words, percent, id_col, text_col)
    return pairs_within(roots, sets, percent, block_sets, False), _named(summary.where("n is not null").select("id", "n", "sid"), roots, id_col)


def link_counts(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block_sets: int = BLOCK_SETS) -> DataFrame:
    """id, n_shingles, component_id and n_links of every row: to how many other sets its own one is similar."""
    summary = stored(summaries(docs, words, id_col, text_col), "summaries")
    roots, sets = set_components(docs, summary, words, percent, id_col, text_col)
    counts = pairs_within(roots, sets, percent, block_sets, True).groupBy("sid").agg(F.sum("n_links").alias("n_links"))
    members = _named(summary.where("n is not null").select("id", "n", "sid"), roots, id_col)
    return members.join(stored(counts, "link-counts"), "sid", "left").select(id_col, "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, for each component: the one with the
    smallest id (null comes last), then the smallest hash of the text; of rows that
    repeat id and text, one. Rows without words stay. Rows are told apart by id and
    text, so an id that repeats with other texts, or null, decides nothing for them."""
    summary = stored(summaries(docs, words, id_col, text_col), "summaries")
    roots, _ = set_components(docs, summary, words, percent, id_col, text_col)
    rows = summary.where("n > 0").groupBy("id", "h", "sid").agg(F.count("*").alias("rows"))
    rows = rows.join(roots.toDF("sid", "root"), "sid", "left").select("id", "h", "rows", F.coalesce("root", "sid").alias("root"))
    rows = stored(rows, "rows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    best = stored(rows.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("members")), "best")
    marked = with_groups(rows, best, "root", "members", rows.count()).withColumn("stays", F.col("id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h")))
    # what leaves, and what stays but is repeated
    marked = stored(marked.where("not stays or rows > 1").select("id", "h", "stays"), "marked")
    keys = {"id": F.col(id_col), "h": F.xxhash64(text_col)}
    return without(docs, keys, marked.where("not stays"), marked.where("stays"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS l FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(l) >= 5 THEN list_distinct([array_to_string(l[i:i + 4], ' ') FOR i IN range(1, len(l) - 3)])
                             WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), u AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), r AS (
  SELECT doc_id AS place, doc_id AS seen FROM n UNION SELECT u.b, r.seen FROM r JOIN u ON u.a = r.place
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT place AS doc_id, min(seen) AS component_id FROM r GROUP BY place) c USING (doc_id)
"""
#: As above, and for each document the number of other sets that its own one is similar to.
LINKS_SQL = (
    ORACLE_SQL[: ORACLE_SQL.index("SELECT w.doc_id")].rstrip()
    + r""", m AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(l)) AS own FROM (SELECT doc_id, list(g) AS l FROM s GROUP BY doc_id)
), k AS (
  SELECT x.own, count(DISTINCT y.own) AS n_links FROM u JOIN m x ON x.doc_id = a JOIN m y ON y.doc_id = b WHERE x.own <> y.own GROUP BY x.own
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(k.n_links, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT place AS doc_id, min(seen) AS component_id FROM r GROUP BY place) c USING (doc_id)
LEFT JOIN m USING (doc_id) LEFT JOIN k ON k.own = m.own
"""
)
