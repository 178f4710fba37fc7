"""Approximate nearest neighbours by learned partitions (operator 4).

Fitting, on a bounded sample of ``sample_rows`` vectors: their k-nearest-neighbour
graph is cut into equal parts by repeated bisection (the graph's slow eigenvector
gives an order, the median cuts it, swaps of pairs that gain edges refine the cut),
then a small network learns to tell a vector's part from the vector, with the parts of
its neighbours as soft labels. Indexing: the network assigns every vector to a part.
Searching: the network routes a query to its most probable parts, as many as sampled
vectors that were not fitted need for a recall of ``RECALL``; these are searched exactly.

The number of parts grows with the square root of the table, and the sample with it, so
the work for a query does too, up to ``MOST_PARTS`` (a thousand million vectors); beyond
that parts grow with the table. A part's size changes no result but the recall's margin.

Spark joins queries and parts in blocks: a part is cut into blocks of about
``BLOCK_ROWS`` vectors and its queries into blocks of about ``QUERY_ROWS``, whatever the
part's size; each pair of blocks is one group, and its best k rows for each query meet
in a final ranking. Distances are Euclidean, in double precision from the original
vectors.

Defined results: vectors that are null, zero, of another length than most of the sample
or that hold null or non-finite components take no part, nor do rows without an id;
ties go to the smaller id; rows that repeat an id are candidates each, but none of them
for a query of that id, and a repeated id asks once, with the smallest of its vectors;
with fewer than k candidates all are returned; an empty table
gives an empty result. Columns besides id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import stored

#: Neighbours of the graph, recall that routing has to reach on sampled vectors that were
#: not fitted, and how many these are at most.
GRAPH_K, RECALL, HELD = 10, 0.98, 1_000
BLOCK_ROWS, QUERY_ROWS = 20_000, 20_000
#: A table of n vectors has about sqrt(n) / ROOT parts, within these limits.
ROOT, LEAST_PARTS, MOST_PARTS = 4, 8, 8_192
HIDDEN, EPOCHS, BATCH = 64, 30, 256


def part_count(rows: int) -> int:
    """A power of two."""
    parts = 2 ** round(math.log2(max(1.0, math.sqrt(rows) / ROOT)))
    return min(MOST_PARTS, max(LEAST_PARTS, parts))


def sample_rows(parts: int) -> int:
    """32 vectors for each part, 4,096 at least (262,144 at most, by MOST_PARTS)."""
    return max(4_096, 32 * parts)


@dataclass
class Router:
    """A network with one hidden layer: vectors to probabilities of parts."""

    mean: np.ndarray
    scale: float
    layers: list[np.ndarray]
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) * self.scale @ w1 + b1, 0) @ w2 + b2


def neighbours(x: np.ndarray, k: int, queries: np.ndarray | None = None) -> np.ndarray:
    """The k nearest other rows of x for each of the rows ``queries``."""
    rows = np.arange(len(x)) if queries is None else queries
    norm, out = (x * x).sum(1), []
    step = max(1, (1 << 22) // max(1, len(x)))
    for lo in range(0, len(rows), step):
        own = rows[lo : lo + step]
        d = norm - 2 * x[own] @ x.T
        d[np.arange(len(own)), own] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) else np.argsort(d, axis=1)[:, : len(x) - 1])
    return np.concatenate(out)


def balanced_parts(near: np.ndarray, parts: int, seed: int = 1) -> np.ndarray:
    """Cut the neighbour graph into ``parts`` (a power of two) parts of equal size."""
    n = len(near)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    label, rnd = np.zeros(n, np.int64), np.random.default_rng(seed)
    for _ in range(int(math.log2(parts))):
        after = np.zeros(n, np.int64)
        for part in np.unique(label):
            own = np.flatnonzero(label == part)
            spot = np.full(n, -1)
            spot[own] = np.arange(len(own))
            inside = (spot[a] >= 0) & (spot[b] >= 0)
            side = _bisect(spot[a[inside]], spot[b[inside]], len(own), rnd)
            after[own] = 2 * part + side
        label = after
    return label


def _bisect(a: np.ndarray, b: np.ndarray, n: int, rnd: np.random.Generator) -> np.ndarray:
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1e-9
    root = np.sqrt(degree)
    first = root / np.linalg.norm(root)
    x = rnd.normal(size=n)
    for _ in range(60):
        y = x / root
        y = (np.bincount(a, y[b], n) + np.bincount(b, y[a], n)) / root + x
        y -= first * (first @ y)
        x = y / (np.linalg.norm(y) + 1e-12)
    side = np.zeros(n, np.int64)
    side[np.argsort(x / root, kind="stable")[n // 2 :]] = 1
    for _ in range(20):  # swap the pairs of rows with most edges to the other side
        across = side[a] != side[b]
        gain = 2 * (np.bincount(a, across, n) + np.bincount(b, across, n)) - degree
        zero, one = (np.flatnonzero(side == s) for s in (0, 1))
        zero, one = zero[np.argsort(-gain[zero], kind="stable")], one[np.argsort(-gain[one], kind="stable")]
        m = min(len(zero), len(one), max(1, n // 50))
        good = gain[zero[:m]] + gain[one[:m]] > 2
        if not good.any():
            break
        cut = across.sum()
        moved = side.copy()
        moved[zero[:m][good]], moved[one[:m][good]] = 1, 0
        if (moved[a] != moved[b]).sum() >= cut:
            break
        side = moved
    return side


def fit(x: np.ndarray, parts: int, recall: float = RECALL, seed: int = 1) -> Router:
    """Cut the sample's graph, learn the parts, and find how many to probe: some rows of
    the sample are held out, and routed to the parts of their neighbours among the rest."""
    x = x.astype(np.float64)
    mean, scale = x.mean(0), 1 / (x.std() + 1e-12)
    rnd = np.random.default_rng(seed)
    order = rnd.permutation(len(x))
    held, own = order[: min(HELD, len(x) // 8)], order[min(HELD, len(x) // 8) :]
    while parts > 1 and len(own) < 16 * parts:
        parts //= 2
    if parts < 2 or not len(held):
        zero = [np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)]
        return Router(mean, scale, zero, 1)
    y = x[own]
    near = neighbours(y, min(GRAPH_K, len(y) - 1))
    label = balanced_parts(near, parts, seed)
    told = label[np.column_stack((near, np.arange(len(y))))]  # a row's own part and its neighbours'
    z = (y - mean) * scale
    layers = [rnd.normal(size=(x.shape[1], HIDDEN)) * (2 / x.shape[1]) ** 0.5, np.zeros(HIDDEN), rnd.normal(size=(HIDDEN, parts)) * (1 / HIDDEN) ** 0.5, np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(EPOCHS):
        order = rnd.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            now = order[lo : lo + BATCH]
            h = np.maximum(z[now] @ layers[0] + layers[1], 0)
            out = h @ layers[2] + layers[3]
            p = np.exp(out - out.max(1, keepdims=True))
            back = p / p.sum(1, keepdims=True)
            np.add.at(back, (np.arange(len(now))[:, None], told[now]), -1 / told.shape[1])
            back /= len(now)
            inner = (back @ layers[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((z[now].T @ inner, inner.sum(0), h.T @ back, back.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(mean, scale, layers)
    placed = np.concatenate([np.argmax(router.logits(part), axis=1) for part in np.array_split(y, -(-len(y) // 4096))])
    norm, wanted = (y * y).sum(1), []
    for v in x[held]:
        d = norm - 2 * (y @ v)
        wanted.append(placed[np.argpartition(d, GRAPH_K - 1)[:GRAPH_K] if GRAPH_K < len(y) else np.arange(len(y))])
    ranks = np.argsort(np.argsort(-router.logits(x[held]), axis=1, kind="stable"), axis=1)
    found = np.take_along_axis(ranks, np.array(wanted), 1)
    router.probes = int(np.sort(found, axis=None)[min(found.size - 1, math.ceil(recall * found.size) - 1)]) + 1
    return router


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, parts: int | None = None, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found rows of ``vectors`` for each
    row of ``queries``, which has the same columns."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    total = rows.count()
    if parts is None:
        parts = part_count(total)
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows(parts)).collect()
    out = f"query_id long, rank int, {id_col} long, score double"
    if not taken:
        return spark.createDataFrame([], out)
    lengths, counts = np.unique([len(r.v) for r in taken], return_counts=True)
    width = int(lengths[counts.argmax()])
    router = fit(np.array([r.v for r in taken if len(r.v) == width]), parts, recall)
    held = spark.sparkContext.broadcast(router)
    rows = rows.where(F.size("v") == width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                part = np.argmax(held.value.logits(matrix(b.column(1))), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))], ["id", "v", "part"])

    index = stored(rows.mapInArrow(assign, "id long, v array<double>, part int"), "ann-index")
    sizes = {r.part: r["count"] for r in index.groupBy("part").count().collect()}  # a row for each part
    asked = valid(queries, id_col, vector_col).where(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.array([sizes.get(p, 0) for p in range(held.value.layers[3].size)])
        for b in batches:
            if not len(b):
                continue
            order = np.argsort(-held.value.logits(matrix(b.column(1))), axis=1, kind="stable")
            # more parts where the probable ones hold fewer than k other rows
            enough = np.cumsum(room[order], axis=1) > k
            need = np.where(enough.any(1), enough.argmax(1) + 1, order.shape[1])
            many = np.maximum(need, held.value.probes)
            at = np.repeat(np.arange(len(b)), many)
            part = np.concatenate([o[:m] for o, m in zip(order, many, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(part.astype(np.int32))], ["id", "v", "part"])

    routed = stored(asked.mapInArrow(route, "id long, v array<double>, part int"), "ann-queries")
    loads = {r.part: r["count"] for r in routed.groupBy("part").count().collect()}  # a row for each part
    grid = [(p, -(-n // BLOCK_ROWS), -(-loads[p] // QUERY_ROWS)) for p, n in sizes.items() if p in loads]
    if not grid:
        return spark.createDataFrame([], out)
    grid = F.broadcast(spark.createDataFrame(grid, "part int, blocks int, batches int"))
    block, batch = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id"), F.col("batches")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(grid, "part").select("id", "v", "part", block.alias("block"), every("batches").alias("batch"))
    right = routed.join(grid, "part").select("id", "v", "part", batch.alias("batch"), every("blocks").alias("block"))

    def nearest(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(rows) and len(asked):
            ids, x = rows["id"].to_numpy(), matrix(rows["v"].combine_chunks())
            norm = (x * x).sum(1)
            for q, v in zip(asked["id"].to_numpy(), matrix(asked["v"].combine_chunks()), strict=True):
                rough = norm - 2 * (x @ v) + v @ v
                rough[ids == q] = np.inf
                m = min(k, len(rough))
                limit = np.partition(rough, m - 1)[m - 1]
                slack = 1e-9 * (norm.max() + v @ v)
                near = np.flatnonzero((rough <= limit + slack) & (ids != q))
                exact = np.sqrt(((x[near] - v) ** 2).sum(1))
                best = np.lexsort((ids[near], exact))[:k]
                found.append((np.full(len(best), q), ids[near][best], exact[best]))
        one, two, three = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": one.astype(np.int64), "id": two.astype(np.int64), "score": three})

    keys = ["part", "block", "batch"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
