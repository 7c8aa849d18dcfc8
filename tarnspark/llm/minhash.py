"""Near duplicates by min-max hashing: both extremes under each permutation, banded; links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Permutations; each gives a minimum and a maximum, so a signature has twice as many values.
PERMUTATIONS = 60
#: The chance that a pair just at the threshold shares no band.
MISSED = 1e-6
#: Counters of shingles: bounded, whatever the input.
COUNTERS = 1 << 19


@lru_cache(maxsize=4)
def permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends: h -> a * h + b is a permutation of the 64-bit numbers."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1), draw.integers(0, 1 << 64, n, dtype=np.uint64)


def banding(values: int, threshold: float, missed: float = MISSED) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold shares no band with a chance of at most `missed`."""
    for rows in range(16, 1, -1):
        if (1 - threshold**rows) ** (values // rows) <= missed:
            return values // rows, rows
    return values, 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit hashes, all rows in a row, and where each row begins (one more than rows).

    Words are parted by ASCII white space, A-Z in lower case. A row of fewer than `size` words, but of some, has one
    shingle of them all; a row without words has none.
    """
    words = shared.Words(column, plain=False)
    n = len(column)
    if not len(words.which):
        return np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.distinct), dtype=np.uint64, count=len(words.distinct))[words.which]
    counts, before = words.counts, words.before
    with np.errstate(over="ignore"):
        rolled = np.full(len(h), 0x9E3779B97F4A7C15, dtype=np.uint64)
        for k in range(min(size, len(h))):
            rolled[: len(h) - k] = _mix(rolled[: len(h) - k] * np.uint64(31) + h[k:])
    left = before[1:][words.row] - np.arange(len(h))  # words from here to the row's end
    take = left >= size
    row, h_of = words.row[take], rolled[take]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([xxhash.xxh3_64_intdigest(h[before[k] : before[k + 1]].tobytes(), seed=size) for k in short.tolist()], dtype=np.uint64)
        row, h_of = np.append(row, short), np.append(h_of, whole)
    order = np.lexsort((h_of, row))
    row, h_of = row[order], h_of[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h_of[1:] != h_of[:-1])
    row, h_of = row[new], h_of[new]
    return h_of, np.searchsorted(row, np.arange(n + 1))


def signatures(h: np.ndarray, starts: np.ndarray, permutations_: int = PERMUTATIONS) -> np.ndarray:
    """Minimum of each permutation, then maximum of each, a row for each set that isn't empty."""
    a, b = permutations(permutations_)
    at = starts[:-1][np.diff(starts) > 0]
    out = np.empty((len(at), 2 * permutations_), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(permutations_ if len(at) else 0):
            x = h * a[k] + b[k]
            out[:, k] = np.minimum.reduceat(x, at)
            out[:, permutations_ + k] = np.maximum.reduceat(x, at)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; no band holds both extremes of a permutation, and keys of different bands differ."""
    out = np.empty((len(signature), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(signature), b + 1, dtype=np.uint64)
            for c in range(rows):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + c])
            out[:, b] = key
    return out


def sketch(docs: DataFrame, *, shingle: int, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (a 128-bit hash of the shingle set), bands (array of keys) for each row; empty sets have neither."""
    bands, rows_each = banding(2 * PERMUTATIONS, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.blocks_of(batch, "text"):
                h, starts = shingle_sets(part.column("text"), shingle)
                sizes = np.diff(starts)
                some = sizes > 0
                raw = h.tobytes()
                digest = [xxhash.xxh3_128_intdigest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
                keys = band_keys(signatures(h, starts), bands, rows_each).view(np.int64)
                ends = np.append(0, np.cumsum(np.where(some, bands, 0)))
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_shingles": pa.array(sizes, pa.int64()),
                        "k1": pa.array([None if d is None else (d >> 64) - (1 << 63) for d in digest], pa.int64()),
                        "k2": pa.array([None if d is None else (d & (1 << 64) - 1) - (1 << 63) for d in digest], pa.int64()),
                        "bands": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel())),
                    }
                )

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return shared.map_arrow(rows, run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, k1, k2, shingles: the shingle sets of the classes (k1, k2), each from the texts of its node (a doc_id) once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.blocks_of(batch, "text"):
                h, starts = shingle_sets(part.column("text"), shingle)
                raw, at = h.tobytes(), starts.tolist()
                same = [xxhash.xxh3_128_intdigest(raw[8 * a : 8 * b]) == (k1 + (1 << 63) << 64 | k2 + (1 << 63)) for a, b, k1, k2 in zip(at, at[1:], part.column("k1").to_pylist(), part.column("k2").to_pylist(), strict=False)]
                sets = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.record_batch({"node": part.column("doc_id"), "k1": part.column("k1"), "k2": part.column("k2"), "shingles": sets}).filter(pa.array(same))

    rows = shared.maybe_in(docs.select("doc_id", "text"), nodes.select("node"), "doc_id")
    rows = rows.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", "text", "k1", "k2")
    return shared.map_arrow(rows, run, "node long, k1 long, k2 long, shingles array<long>").dropDuplicates(["k1", "k2"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes of which two full sets have an intersection of at least percent / 100 of their union.

    A node has one set, but for doc_ids that stand on different texts."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared_n = F.size(F.array_intersect("x", "y")).cast("bigint")
    return both.select("a", "b", shared_n.alias("i"), (F.size("x") + F.size("y")).alias("n")).filter(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) for every node of the edges (a, b), by alternating large and small stars.

    Each step is two aggregations and joins, written to the shared folder; the number of steps grows with the logarithm
    of the longest path. Nothing but a count and a checksum comes to the driver.
    """

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = shared.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        before = now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = shared.written(small, "edges")
        shared.discard(before)
        if (mark_now := mark(now)) == seen:
            break
        seen = mark_now
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall to each of COUNTERS counters; that many numbers come to the driver, at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column("shingles").flatten().to_numpy().view(np.uint64) % np.uint64(COUNTERS), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.record_batch({"counter": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    found = shared.map_arrow(sets.select("shingles"), count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[found["counter"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among the nodes of open buckets that can reach percent, by prefix and position.

    open_: bucket, node, component, and main, the bucket's largest component. One node of each pair stands aside of it.

    Shingles are ordered by the counts of their counters (`shingle_counts`), the rarest first, then by hash: any one order
    serves. Two sets of n and m that reach percent share at least percent / (100 + percent) of n + m; so they share a
    shingle at places i and j of their orders with at least as many from there on in both. Copies edited apart differ in
    their rarest shingles, and are not even paired. Only prefixes, a seventh of all shingles at 85 percent, are dealt out.
    """
    counts = shingle_counts(sets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("shingles")
            starts = lists.offsets.to_numpy().astype(np.int64)
            starts -= starts[0]
            token = lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            order = np.lexsort((token, counts[token % np.uint64(COUNTERS)], row))
            place = np.arange(len(token)) - starts[row]
            keep = (np.diff(starts)[row] - place) * 100 >= percent * np.diff(starts)[row]
            at = pa.array(row[keep])
            columns = {c: batch.column(c).take(at) for c in ("node", "n", "component", "aside")}
            yield pa.record_batch({"token": pa.array(token[order][keep].view(np.int64)), **columns, "i": pa.array(place[keep])})

    nodes = open_.groupBy("node").agg(F.min("component").alias("component"), F.max((F.col("component") != F.col("main")).cast("int")).alias("aside"))
    held = nodes.join(sets, "node").select("node", F.size("shingles").cast("bigint").alias("n"), "component", "aside", "shingles")
    prefix = shared.written(shared.map_arrow(held, cut, "token long, node long, n long, component long, aside int, i long"), "prefixes")
    x = prefix.filter("aside = 1").select("token", F.col("node").alias("a"), F.col("n").alias("an"), F.col("component").alias("ac"), F.col("i").alias("ai"))
    y = prefix.select("token", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("component").alias("bc"), F.col("i").alias("bi"), "aside")
    enough = F.least(F.col("an") - F.col("ai"), F.col("bn") - F.col("bi")) * (100 + percent) >= percent * (F.col("an") + F.col("bn"))
    return x.join(y, "token").filter((F.col("ac") != F.col("bc")) & ((F.col("aside") == 0) | (F.col("a") < F.col("b"))) & enough).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; documents are linked at 100 * intersection >= percent * union.

    1. One pass makes each text's shingle set, its hash and its band keys. Rows of equal sets become one node, named by
       the least doc_id, in an aggregation with map-side combine: a group of copies of any size is one node from here on.
    2. Nodes that share a band key stand in a bucket. Each is paired with the least node of its bucket only; pairs whose
       sizes allow it are confirmed on the full sets, and linked nodes grouped into components.
    3. In buckets that still hold several components, nodes outside the bucket's largest one are paired with nodes of
       other components, where prefix and position of their shingles allow it (`_prefix_pairs`); these pairs are
       confirmed as well. So each pair that shares a bucket is confirmed, ruled out or joined already.

    A pair at the threshold shares no band with a chance of MISSED. Null or empty texts, and texts without words, have an
    empty set, link with nothing and are kept. A null doc_id links with nothing and is kept, with a null component.
    Rows that repeat a doc_id count as one document; each has its row, with that document's component. Where they have
    different texts, the document is linked to what any of them is linked to. No rows: no rows.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketches = shared.written(sketch(rows, shingle=shingle, threshold=percent / 100), "sketches")
    known = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = shared.written(nodes, "nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count("*").alias("c"), F.min("node").alias("hub")).filter("c > 1")
    inside = shared.written(banded.join(full, "bucket").select("bucket", "hub", "node", "n"), "buckets")
    members = shared.written(inside.select("node").distinct().join(nodes.select("node", "n", "k1", "k2"), "node"), "members")
    sets = shared.written(_sets(rows.filter("doc_id IS NOT NULL"), members.select("node", "k1", "k2"), shingle), "sets")

    like = lambda m, n: 100 * F.least(m, n) >= percent * F.greatest(m, n)
    hubs = inside.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"), "n").distinct()
    hubs = hubs.join(members.select(F.col("node").alias("b"), F.col("n").alias("m")), "b").filter(like(F.col("m"), F.col("n"))).select("a", "b").distinct()
    linked = confirmed(hubs, sets, percent).unionByName(_same_id(known, nodes))
    labels = shared.written(components(linked), "components")

    placed = inside.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = shared.written(placed.select("bucket", "node", "component"), "placed")
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    most = sizes.groupBy("bucket").agg(F.max(F.struct("c", F.col("component").alias("main"))).alias("m"), F.count("*").alias("k")).filter("k > 1").select("bucket", "m.main")
    open_ = shared.written(placed.join(most, "bucket"), "open")
    if not open_.isEmpty():
        # links between components: a graph of components alone, much smaller than that of nodes
        more = shared.written(confirmed(_prefix_pairs(open_, sets, percent), sets, percent).distinct(), "links")
        of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
        between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
        joined = components(between).select(F.col("node").alias("part"), F.col("component").alias("whole"))
        nodes = nodes.join(labels, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        nodes = nodes.join(joined, "part", "left").withColumn("class", F.coalesce("whole", "part"))
    else:
        nodes = nodes.join(labels, "node", "left").withColumn("class", F.coalesce("component", "node"))

    # empty texts, which may be many, have no class and take no part in the join
    held = sketches.filter("n_shingles > 0").join(nodes.select("k1", "k2", "class"), ["k1", "k2"], "left").select("doc_id", "n_shingles", "class")
    out = held.unionByName(sketches.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class")))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the nodes of the classes that one doc_id stands in, where it has different texts."""
    twice = known.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    each = known.select("doc_id", "k1", "k2").join(twice, "doc_id").distinct().join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("doc_id", "node")
    return each.join(each.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"), shingle=3, percent=85)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id, with all rows that repeat its id.

    Null and empty texts and rows with a null doc_id stay, as nothing is like them; very long texts are compared whole.
    All columns stay as they are, whatever they are called. No rows: no rows.
    """
    found = near_duplicates(docs, shingle=5, percent=80)
    return docs.join(found.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)
