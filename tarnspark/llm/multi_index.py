"""Approximate nearest neighbours by an inverted multi-index: two vector halves quantised apart, cells visited in order of summed distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnspark.functions.shipping import ship

from . import shared

#: Rows that the centroids are fitted on, at most; every row is indexed.
SAMPLE = 8192
#: Queries whose true neighbours are sought among all rows, to see how far queries must go.
TRIED = 128
#: Entries of a block, and queries, that one task scores; STEP queries at a time.
BLOCK, QUERIES, STEP = 4096, 4096, 256


@dataclass
class Index:
    """Centroids of both halves, rows in each cell (first centroid * n + second), and which blocks hold each cell.

    A block holds a run of neighbouring cells of BLOCK rows together, or a part of one cell that has more.
    """

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        self.block, self.parts = np.zeros(len(self.counts), dtype=np.int64), np.zeros(len(self.counts), dtype=np.int64)
        low, high, room = [], [], 0
        for c in np.flatnonzero(self.counts).tolist():
            n = int(self.counts[c])
            if n > room:
                self.block[c], self.parts[c] = len(low), -(-n // BLOCK)
                low += [c] * int(self.parts[c])
                high += [c + 1] * int(self.parts[c])
                room = BLOCK - n if n <= BLOCK else 0
            else:
                self.block[c], self.parts[c] = len(low) - 1, 1
                high[-1], room = c + 1, room - n
        self.low, self.high = np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)

    @property
    def width(self) -> int:
        return len(self.second)

    def visited(self, near_first: np.ndarray, near_second: np.ndarray, wanted: int) -> tuple[np.ndarray, int]:
        """Which cells a query visits, and how many rows they hold."""
        seen = np.zeros(len(self.counts), dtype=bool)
        at = np.array(visit(near_first, near_second, self.counts, wanted), dtype=np.int64).reshape(-1, 2)
        seen[at[:, 0] * self.width + at[:, 1]] = True
        return seen, int(self.counts[seen].sum())


def _usable(vector, dim: int):
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == dim) & F.coalesce(ok, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def kmeans(rows: np.ndarray, n: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """n centroids of the rows (fewer if there are fewer distinct rows)."""
    distinct = np.unique(rows, axis=0)
    centroids = distinct[np.random.default_rng(seed).permutation(len(distinct))[:n]].copy()
    for _ in range(rounds):
        near = nearest(rows, centroids)
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rows)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)


def visit(near_first: np.ndarray, near_second: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Pairs (i, j) of centroids by falling sum of their two inner products, until their cells hold `wanted` rows.

    The two lists are sorted; a heap holds the frontier of pairs whose upper and left neighbours have been visited.
    """
    by_first, by_second = np.argsort(-near_first, kind="stable"), np.argsort(-near_second, kind="stable")
    f, s = (-near_first[by_first]).tolist(), (-near_second[by_second]).tolist()
    a, b = by_first.tolist(), by_second.tolist()
    n, width, sizes = len(f), len(s), counts.tolist()
    heap, out, reached = [(f[0] + s[0], 0, 0)], [], 0
    done = [0] * n  # pairs visited so far in each row of the frontier
    while heap and reached < wanted:
        _, x, y = heappop(heap)
        out.append((a[x], b[y]))
        reached += sizes[a[x] * width + b[y]]
        done[x] = y + 1
        if y + 1 < width and (x == 0 or done[x - 1] > y + 1):
            heappush(heap, (f[x] + s[y + 1], x, y + 1))
        if x + 1 < n and done[x + 1] == y:
            heappush(heap, (f[x + 1] + s[y], x + 1, y))
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def centroids_for(n: int) -> int:
    """A quarter of the root of the rows, 8 at least and 64 at most: cells of a few rows each, or 4,096 cells."""
    return min(64, max(8, round(math.sqrt(n) / 4)))


def _nearest_of_all(indexed: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """query (its place in ids), i, j: the cells of the k rows nearest to each of a few queries, by looking at all rows.

    Each task keeps k rows a query; what is gathered grows with the partitions, not the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(q)
        best, cell, known = np.full((n, k), -np.inf), np.zeros((n, k, 2), dtype=np.int32), np.zeros((n, k), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("vec_id").to_numpy()
            near = q @ _matrix(batch.column("v"), q.shape[1]).T
            near[ids[:, None] == own[None, :]] = -np.inf
            cells = np.stack([batch.column("i").to_numpy(), batch.column("j").to_numpy()], axis=1)
            both = np.concatenate([best, near], axis=1)
            take = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(both, take, axis=1)
            known = np.take_along_axis(np.concatenate([known, np.broadcast_to(own, near.shape)], axis=1), take, axis=1)
            cell = np.take_along_axis(np.concatenate([cell, np.broadcast_to(cells, (n, *cells.shape))], axis=1), take[:, :, None], axis=1)
        r, c = np.nonzero(best > -np.inf)
        yield pa.record_batch({"query": pa.array(r, pa.int32()), "score": pa.array(best[r, c]), "vec_id": pa.array(known[r, c]), "i": pa.array(cell[r, c, 0]), "j": pa.array(cell[r, c, 1])})

    found = shared.map_arrow(indexed.select("vec_id", "v", "i", "j"), run, "query int, score double, vec_id long, i int, j int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "i", "j")


def _far_enough(index: Index, near: list[tuple[np.ndarray, np.ndarray]], truth: pa.Table, recall: float) -> int:
    """How many rows queries must see so that of all true neighbours of the tried ones the share `recall` is among them."""
    query, cell = truth["query"].to_numpy(), truth["i"].to_numpy().astype(np.int64) * index.width + truth["j"].to_numpy()
    depth = []
    for r, (x, y) in enumerate(near):
        at = np.array(visit(x, y, index.counts, int(index.counts.sum())), dtype=np.int64).reshape(-1, 2)
        cells = at[:, 0] * index.width + at[:, 1]
        upto = np.zeros(len(index.counts), dtype=np.int64)
        upto[cells] = np.cumsum(index.counts[cells])
        depth.append(upto[cell[query == r]])
    depth = np.sort(np.concatenate(depth))
    return int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)) - 1)]) if len(depth) else 0


def search(
    vectors: DataFrame,
    *,
    is_query,
    k: int = 20,
    centroids: int | None = None,
    recall: float = 0.94,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, n_scored: for each row where is_query holds, the k rows of largest inner product found.

    Each half of the vectors gets `centroids` centroids (`centroids_for` the rows), fitted on SAMPLE rows of least id
    hash; every row is indexed. A query visits cells in order of the two halves' summed inner products and scores all
    their entries in double precision (n_scored of them). How far queries go is measured: TRIED queries of least id hash
    are held against all rows, and all go as far as it takes to find the share `recall` of those queries' true neighbours.
    Vectors without structure need about half of all rows, clustered ones a few hundredths.

    Entries stand in blocks of about BLOCK rows of neighbouring cells, so a cell that holds a third of all rows is spread
    over many. A query goes to the blocks that hold cells it visits; a block is copied once for each QUERIES queries that
    come to it, and not at all if none does. Ties go to the smaller vec_id. Vectors that are null, zero, of another length
    than most, or hold null or non-finite numbers take no part, nor do null ids. Rows with the query's own id are no
    candidates; a repeated query id is one query. An empty table gives no rows; with k candidates or fewer, all are
    returned.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    usual = rows.filter("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    dim = usual.n if usual else 1
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & _usable(F.col("v"), dim))
    half = max(1, dim // 2)
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()], dtype=np.float64).reshape(-1, dim)
    schema = "query_id long, rank int, vec_id long, score double, n_scored long"
    if not len(sample):
        return spark.createDataFrame([], schema)

    def halves(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return m[:, :half], m[:, half:] if dim > 1 else np.zeros((len(m), 1))

    first, second = (kmeans(x, centroids or centroids_for(usual.c)) for x in halves(sample))
    width = len(second)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = halves(_matrix(batch.column("v"), dim))
                yield batch.append_column("i", pa.array(nearest(x, first), pa.int32())).append_column("j", pa.array(nearest(y, second), pa.int32()))

    indexed = shared.written(shared.map_arrow(rows, assign, "vec_id long, v array<double>, q boolean, i int, j int"), "vectors")
    counts = np.zeros(len(first) * width, dtype=np.int64)
    for r in indexed.groupBy("i", "j").agg(F.count("*").alias("n")).collect():  # one row a cell, centroids ** 2 at most
        counts[r.i * width + r.j] = r.n
    index = Index(first, second, counts)
    queries = indexed.filter("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    tried = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIED).collect()
    if not tried:
        return spark.createDataFrame([], schema)
    m = np.array([r.v for r in tried], dtype=np.float64)
    x, y = halves(m)
    truth = _nearest_of_all(indexed, np.array([r.vec_id for r in tried]), m, k).toArrow()
    wanted = max(k + 1, _far_enough(index, list(zip(x @ first.T, y @ second.T, strict=True)), truth, recall))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = halves(_matrix(batch.column("v"), dim))
            near_first, near_second = x @ index.first.T, y @ index.second.T
            at, blocks, masks, rows_seen = [], [], [], []
            for r in range(batch.num_rows):
                seen, n = index.visited(near_first[r], near_second[r], wanted)
                before = np.append(0, np.cumsum(seen))
                for b in np.flatnonzero(before[index.high] > before[index.low]).tolist():
                    at.append(r)
                    blocks.append(b)
                    masks.append(np.packbits(seen[index.low[b] : index.high[b]], bitorder="little").tobytes())
                    rows_seen.append(n)
            yield pa.record_batch(
                {
                    "block": pa.array(blocks, pa.int32()),
                    "query_id": batch.column("vec_id").take(pa.array(at)),
                    "v": batch.column("v").take(pa.array(at)),
                    "cells": pa.array(masks, pa.binary()),
                    "n_scored": pa.array(rows_seen, pa.int64()),
                }
            )

    def best_of(q: np.ndarray, own: np.ndarray, masks: np.ndarray, e: np.ndarray, ids: np.ndarray, by_cell: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = np.full((len(q), len(e)), -np.inf)
        for c, a, b in by_cell:
            asking = np.flatnonzero(masks[:, c])
            if len(asking):
                near[asking, a:b] = q[asking] @ e[a:b].T
        near[own[:, None] == ids[None, :]] = -np.inf
        # the k best of each query, and what ties with the last of them but for rounding
        last = np.partition(near, len(e) - k, axis=1)[:, len(e) - k] if len(e) > k else np.full(len(q), -np.inf)
        rounding = 8 * dim * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(e, axis=1).max()
        r, c = np.nonzero((near >= (last - rounding)[:, None]) & (near > -np.inf))
        exact = np.einsum("ij,ij->i", q[r], e[c])
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[keep], ids[c[keep]], exact[keep]

    def score(entries: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if entries.num_rows and asked.num_rows:
            low = int(index.low[entries["block"][0].as_py()])
            cell = entries["i"].to_numpy().astype(np.int64) * width + entries["j"].to_numpy() - low
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            e, ids = _matrix(entries["v"], dim)[order], entries["vec_id"].to_numpy()[order]
            q, own = _matrix(asked["v"], dim), asked["query_id"].to_numpy()
            masks = np.unpackbits(np.frombuffer(b"".join(asked["cells"].to_pylist()), dtype=np.uint8).reshape(len(q), -1), axis=1, bitorder="little").astype(bool)
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            by_cell = list(zip(cell[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True))
            for low_q in range(0, len(q), STEP):
                asked_now = slice(low_q, low_q + STEP)
                r, i, s = best_of(q[asked_now], own[asked_now], masks[asked_now], e, ids, by_cell)
                out.append((r + low_q, i, s))
        r, i, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": asked["query_id"].take(pa.array(r)), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64()), "n_scored": asked["n_scored"].take(pa.array(r))})

    routed = shared.written(shared.map_arrow(queries, route, "block int, query_id long, v array<double>, cells binary, n_scored long"), "routed")
    groups = routed.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    of_cell = spark.createDataFrame([(c // width, c % width, int(index.block[c]), int(index.parts[c])) for c in np.flatnonzero(counts).tolist()], "i int, j int, block int, parts int")
    placed = indexed.join(F.broadcast(of_cell), ["i", "j"])  # one small row a cell, centroids ** 2 at most
    placed = placed.select("vec_id", "v", "i", "j", (F.col("block") + F.pmod(F.xxhash64("vec_id"), "parts")).cast("int").alias("block"))
    entries = placed.join(groups, "block").withColumn("asked", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    asking = routed.join(groups, "block").withColumn("asked", F.pmod(F.xxhash64("query_id"), "groups").cast("int")).drop("groups")
    found = entries.groupBy("block", "asked").cogroup(asking.groupBy("block", "asked")).applyInArrow(score, "query_id long, vec_id long, score double, n_scored long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "n_scored")


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(shared.table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0)
