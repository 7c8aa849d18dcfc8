"""Jaccard join of word n-gram sets, aware of their sizes: pairs of tokens for small sets, lists of holders for large ones."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .minhash import _mix, _same_id, _sets, components, confirmed, shingle_sets

#: Sizes of sets at which small may end and large begin; the cost of each is measured.
BOUNDARIES = (0, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512)
#: Rows of a bucket in one part of the join; larger buckets are split on both sides.
HOLDERS = 2000
#: A token that so many rows hold is of level 1, 2 and so on; rarer ones, which most are, of level 0.
LEVELS = (16, 256, 4096, 65536)
#: Bits of the filter of each level: eight for each token of it, so many at least and at most (8 MB). A full one takes rare
#: tokens for frequent ones; any one order of tokens gives the same links.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Shingles that a task deals out at a time, and bytes of text whose shingles are counted together.
DEALT, COUNTED = 1 << 20, 16 << 20


def _place(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A token's part, and the 32 bits that tell it from others there."""
    return (h >> np.uint64(32)) % np.uint64(parts), h & np.uint64(0xFFFFFFFF)


def _slot(part: np.ndarray, low: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (part * np.uint64(0x9E3779B97F4A7C15) ^ low) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def _frequent(rows: DataFrame, shingle: int, parts: int) -> list[np.ndarray]:
    """A filter (bits in a row) of the tokens of each level, counted over all texts.

    Tasks deal their tokens out by part, four bytes each; a part's counts are taken in one array. What comes to the driver
    are the filters, of bounded size."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            part, low = _place(np.concatenate(held), parts)
            held.clear()
            order = np.argsort(part.astype(np.int32), kind="stable")
            part, raw = part[order], low[order].astype("<u4").tobytes()
            at = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 63)))
            ends = np.append(at, len(part))
            return pa.record_batch({"part": pa.array(part[at].astype(np.int32)), "tokens": pa.array([raw[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.binary())})

        for batch in batches:
            for some in shared.blocks_of(batch, "text"):
                h = _shingles(some.column("text"), shingle)
                if len(h):
                    held.append(h)
                if sum(map(len, held)) >= DEALT:
                    yield out()
        if held:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, tokens in zip(batch.column("part").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                held.setdefault(part, []).append(tokens)
        for part in list(held):
            low = np.sort(np.frombuffer(b"".join(held.pop(part)), dtype="<u4"))
            at = np.flatnonzero(np.diff(low, prepend=low[:1] ^ np.uint32(1)))
            n = np.diff(np.append(at, len(low)))
            often = n >= LEVELS[0]
            slot = _slot(np.full(int(often.sum()), part, dtype=np.uint64), low[at][often].astype(np.uint64))
            yield pa.record_batch({"level": pa.array(np.searchsorted(LEVELS, n[often], side="right"), pa.int32()), "slot": pa.array(slot.astype(np.int64))})

    dealt = shared.map_arrow(rows.select("text"), deal, "part int, tokens binary").repartition(parts, "part")
    often = shared.written(shared.map_arrow(dealt, count, "level int, slot long"), "frequent")
    counts = {r.level: r.n for r in often.groupBy("level").agg(F.count("*").alias("n")).collect()}
    sizes = [min(MOST_BITS, max(LEAST_BITS, 1 << (8 * sum(n for at, n in counts.items() if at >= k)).bit_length())) for k in range(1, len(LEVELS) + 1)]
    out = [np.zeros(n // 8, dtype=np.uint8) for n in sizes]
    for k, bits in enumerate(out):
        slots = often.filter(F.col("level") > k).select((F.col("slot") % (8 * len(bits)) + 1).alias("slot"))
        blocks = slots.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        for block, found in blocks.toLocalIterator():
            low = (block - 1) * 4096
            bits[low : low + 4096] |= np.frombuffer(found, dtype=np.uint8)[: len(bits) - low]
    shared.discard(often)
    return out


def _shingles(column: pa.Array, size: int) -> np.ndarray:
    """The hashes of `shingle_sets`, as often as they stand in the texts; texts of fewer words than a shingle have none."""
    words = shared.Words(column, plain=False)
    if not len(words.which):
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.distinct), dtype=np.uint64, count=len(words.distinct))[words.which]
    rolled = np.full(len(h), 0x9E3779B97F4A7C15, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(h))):
            rolled[: len(h) - k] = _mix(rolled[: len(h) - k] * np.uint64(31) + h[k:])
    return rolled[words.before[1:][words.row] - np.arange(len(h)) >= size]


def _up(n, times: int, by: int):
    """n * times / by, rounded up, of whole numbers, arrays or columns of them."""
    if isinstance(n, Column):
        above = n * times + (by - 1)
        return ((above - above % by) / by).cast("bigint")
    return -(-n * times // by)


def _reach(n, percent: int, share: int):
    """Of a set of n: how many tokens, the rarest first, hold `share` common ones with every smaller set that it is like."""
    return n - _up(n, percent, 100) + share


def _indexed(n, percent: int, share: int):
    """The same with every set like it that is no smaller: fewer."""
    return n - _up(n, 2 * percent, 100 + percent) + share


def _sketch(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (a 128-bit hash of the set) and prefix: the rarest tokens, enough for two common ones."""
    parts = shared.parts_for(rows.sparkSession, shared.text_bytes(rows), COUNTED)
    filters = rows.sparkSession.sparkContext.broadcast(_frequent(rows, shingle, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = filters.value
        for batch in batches:
            for part in shared.blocks_of(batch, "text"):
                h, starts = shingle_sets(part.column("text"), shingle)
                n, raw = np.diff(starts), h.tobytes()
                digest = [xxhash.xxh3_128_intdigest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
                row = np.repeat(np.arange(len(n)), n)
                slot, level = _slot(*_place(h, parts)), np.zeros(len(h), dtype=np.int8)
                for bits in levels:
                    at = slot % np.uint64(8 * len(bits))
                    level += bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
                order = np.lexsort((h, level, row))
                keep = np.arange(len(h)) - starts[row] < _reach(n, percent, 2)[row]
                kept = np.bincount(row[keep], minlength=len(n))
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_shingles": pa.array(n, pa.int64()),
                        "k1": pa.array([None if d is None else (d >> 64) - (1 << 63) for d in digest], pa.int64()),
                        "k2": pa.array([None if d is None else (d & (1 << 64) - 1) - (1 << 63) for d in digest], pa.int64()),
                        "prefix": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept)), pa.int32()), pa.array(h[order][keep].view(np.int64))),
                    }
                )

    return shared.map_arrow(rows, run, "doc_id long, n_shingles long, k1 long, k2 long, prefix array<long>")


def _lists(nodes: DataFrame) -> DataFrame:
    """token, node, n, place, holders, hub: the holders of each token that two nodes or more have among their rarest, written.

    hub: the least of them, with its n and place."""
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("place", "token"))
    held = rows.groupBy("token").agg(F.count("*").alias("holders"), F.min(F.struct("node", "n", "place")).alias("hub")).filter("holders > 1")
    return shared.written(rows.join(held, "token"), "lists")


def _open(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key holds several components, with main (the one that most of its rows are of), holders and out (those
    that are not of main)."""
    sizes = rows.groupBy(key, "component").agg(F.count("*").alias("c"))
    most = sizes.groupBy(key).agg(F.max(F.struct("c", F.col("component").alias("main"))).alias("m"), F.sum("c").alias("holders"), F.count("*").alias("k")).filter("k > 1")
    return rows.join(most.select(key, "m.main", "holders", (F.col("holders") - F.col("m.c")).alias("out")), key)


def _viable(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of open lists at whose token a set may still have its first or second one in common with a like set of another
    component: by what is left of it from there on, and of the sets of other components, and by the least of their sizes."""
    aside, rest = F.col("component") != F.col("main"), F.col("n") - F.col("place")
    told = rows.groupBy("token").agg(F.max(F.when(aside, rest)).alias("out_rest"), F.min(F.when(aside, F.col("n"))).alias("out_n"), F.max(rest).alias("all_rest"), F.min("n").alias("all_n"))
    other = lambda c: F.when(aside, F.col(f"all_{c}")).otherwise(F.col(f"out_{c}"))
    least = F.greatest(other("n"), _up(F.col("n"), percent, 100))
    keep = (1 + F.least(rest, other("rest"))) * (100 + percent) >= percent * (F.col("n") + least)
    return rows.join(told, "token").filter(keep).drop("main", "holders", "out", "out_rest", "out_n", "all_rest", "all_n")


def _boundary(held: DataFrame, percent: int) -> int:
    """The size at which lists of holders become cheaper than pairs of tokens, out of BOUNDARIES.

    held: node, n, tokens (struct place, token, scan) of each set. A set below the boundary costs a row for each pair of its
    tokens, one from there on as many as it scans of its tokens' lists. All sets are counted."""
    s = F.size("tokens").cast("bigint")
    lists = F.aggregate(F.filter("tokens", lambda t: t.place < _reach(F.col("n"), percent, 1)), F.lit(0).cast("bigint"), lambda a, t: a + t.scan)
    costs = held.select("n", (s * (s - 1) / 2).alias("pairs"), lists.alias("lists"))
    row = costs.agg(*[F.sum(F.when(F.col("n") < x, F.col("pairs")).otherwise(F.col("lists"))).alias(f"at{x}") for x in BOUNDARIES]).first()
    return min(BOUNDARIES, key=lambda x: (row[f"at{x}"] or 0, x))


def _buckets(lists: DataFrame, percent: int, boundary: int | None) -> DataFrame:
    """bucket, node, n, place, common, probes, indexed, component, main, holders, out: every two like sets of different
    components share a bucket; written.

    Tokens have one order, the rarest first. Two sets of n >= m that reach percent have t = percent * (n + m) / (100 +
    percent) tokens in common, so k of them among the first n - t + k of the one and m - t + k of the other. The larger one
    probes with its `_reach`, the smaller one is indexed with its `_indexed`.

    Small sets (below the boundary) enumerate their subsets of two tokens (k = 2), each a bucket. Large ones probe the lists
    of holders of single tokens (k = 1), where sets stand that are large or near enough to it. Only tokens whose holders are
    of several components count, as no two sets of different components share another one, and of those only the rows at
    which such sets can begin to be alike (`_viable`).
    """
    scan = F.when(F.col("component") == F.col("main"), F.col("out")).otherwise(F.col("holders"))
    held = _open(_viable(_open(lists, "token"), percent), "token").groupBy("node", "n", "component").agg(F.sort_array(F.collect_list(F.struct("place", "token", scan.alias("scan")))).alias("tokens"))
    held = shared.written(held, "tokens")
    if boundary is None:
        boundary = _boundary(held, percent)
    n, own = F.col("n"), ("node", "n", "component")
    later = lambda t, k: F.transform(F.slice("tokens", k + 2, F.size("tokens")), lambda u: F.struct(F.xxhash64(t.token, u.token, F.lit(2)).alias("bucket"), u.place.alias("place")))
    two = held.filter(n < boundary).select(*own, F.explode(F.flatten(F.transform("tokens", later))).alias("t")).select("t.bucket", *own, "t.place", F.lit(2).alias("common"), F.lit(True).alias("probes"))
    # a set of which two common tokens can't be asked for probes lists, however small it is
    tiny = _up(n, percent, 100) < 2
    one = held.filter((n >= _up(boundary, percent, 100)) | tiny).select(*own, F.explode("tokens").alias("t"))
    one = one.select(F.col("t.token").alias("bucket"), *own, "t.place", F.lit(1).alias("common"), (((n >= boundary) | tiny) & (F.col("t.place") < _reach(n, percent, 1))).alias("probes"))
    rows = one.unionByName(two).withColumn("indexed", F.col("place") < _indexed(n, percent, F.col("common")))
    out = shared.written(_open(rows.filter("probes OR indexed"), "bucket"), "buckets")
    shared.discard(held)
    return out


def _can_reach(percent: int, n: Column, i: Column, m: Column, j: Column, common: Column) -> Column:
    """Whether sets of n and m whose first `common` common tokens end at places i and j may reach percent, by sizes and places."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((common + F.least(n - i, m - j) - 1) * (100 + percent) >= percent * (n + m))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a bucket and may reach percent.

    rows: as of `_buckets`. Nodes of `main` are not paired with each other. A bucket of many rows is split into parts on both
    sides, each paired with each, so no task pairs more than about HOLDERS rows with HOLDERS.
    """
    parts = F.ceil(F.col("holders") / F.lit(HOLDERS)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")

    def spread(some: DataFrame, mine: str, other: str) -> DataFrame:
        few = some.filter(parts <= 1).withColumns({mine: F.lit(0), other: F.lit(0)})
        return few.unionByName(some.filter(parts > 1).withColumn(mine, own).withColumn(other, F.explode(F.sequence(F.lit(0), parts - 1))))

    aside = (F.col("component") != F.col("main")).alias("aside")
    x = spread(rows.filter("probes"), "p", "q").select("bucket", "p", "q", aside, "common", F.col("node").alias("a"), F.col("n").alias("an"), F.col("place").alias("ai"), F.col("component").alias("ac"))
    y = spread(rows.filter("indexed"), "q", "p").select("bucket", "p", "q", aside.alias("out"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("place").alias("bi"), F.col("component").alias("bc"))
    smaller = (F.col("bn") < F.col("an")) | (F.col("bn") == F.col("an")) & (F.col("b") < F.col("a"))
    may = (F.col("a") != F.col("b")) & (F.col("ac") != F.col("bc")) & smaller & _can_reach(percent, F.col("an"), F.col("ai"), F.col("bn"), F.col("bi"), F.col("common"))
    on = ["bucket", "p", "q"]
    some = x.filter("aside").join(y.drop("out"), on).filter(may).select("a", "b").unionByName(x.filter("NOT aside").join(y.filter("out").drop("out"), on).filter(may).select("a", "b"))
    return some.distinct()


def _nodes(docs: DataFrame, shingle: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows, a sketch of each, and nodes: one for each different set that holds anything, named by its least doc_id."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = shared.written(_sketch(rows, shingle, percent), "sketches")
    known = whole.filter("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = shared.written(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix")), "nodes")
    sketches = shared.written(whole.drop("prefix"), "sketches")
    shared.discard(whole)
    _drop_shuffles(docs.sparkSession)
    return rows, sketches, nodes


def _drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of plans that nothing refers to once the driver collects garbage, which one with little to
    do may not do for long: asked for here, between steps whose shuffles are no longer read."""
    gc.collect()
    spark._jvm.System.gc()


def _may_link(nodes: DataFrame, percent: int) -> DataFrame:
    """Nodes large enough to be like a set other than their own."""
    return nodes.filter(100 * F.col("n") >= percent * (F.col("n") + 1))


def _hopeful(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that may reach percent by the common tokens of their prefixes.

    Tokens have one order. Up to the end of that prefix which ends first, both prefixes hold all that the sets have in common;
    beyond it, only the rest of its own set can be common: so prefixes' common tokens and the longer rest bound the sets'."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("prefix").alias(f"{c}_prefix"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    rest = F.greatest(F.col("a_n") - F.size("a_prefix"), F.col("b_n") - F.size("b_prefix"))
    common = F.size(F.array_intersect("a_prefix", "b_prefix"))
    return both.filter((common + rest) * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs that reach percent on their full sets, which are made from their texts once more; written."""
    ends = lambda some: some.select(F.col("a").alias("node")).unionByName(some.select(F.col("b").alias("node"))).distinct()
    all_pairs = shared.written(pairs, "pairs")
    pairs = shared.written(_hopeful(all_pairs, nodes.join(ends(all_pairs), "node", "left_semi"), percent), "pairs")
    members = shared.written(ends(pairs).join(nodes.select("node", "k1", "k2"), "node"), "members")
    sets = shared.written(_sets(rows.filter("doc_id IS NOT NULL"), members, shingle), "sets")
    out = shared.written(confirmed(pairs, sets, percent).distinct(), "links")
    for done in (all_pairs, pairs, members, sets):
        shared.discard(done)
    _drop_shuffles(rows.sparkSession)
    return out


def jaccard_links(docs: DataFrame, *, shingle: int = 5, percent: int = 80, boundary: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b: every two different shingle sets with 100 * intersection >= percent * union, each named by its least doc_id.

    All pairs, also within a group of many sets that are like each other; `jaccard_components` goes without those. Edge
    cases as there.
    """
    rows, _, nodes = _nodes(docs, shingle, percent, key, text)
    lists = _lists(_may_link(nodes, percent)).withColumn("component", F.col("node")).drop("holders", "hub")
    found = _confirmed(_pairs(_buckets(lists, percent, boundary), percent), rows, nodes, shingle, percent)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, *, shingle: int = 5, percent: int = 80, boundary: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row; documents are linked at 100 * intersection >= percent * union.

    1. Rows of equal sets become one node, in an aggregation with map-side combine; copies are not paired.
    2. Each node stands in the lists of its rarest tokens, enough of them that like nodes share a list. It is paired with
       the least node of each; pairs that reach percent on full sets group nodes. So a group of many nodes that are like
       each other takes as many pairs as nodes.
    3. Lists that still hold several groups are gone through for pairs of different groups (`_buckets`): small sets
       enumerate subsets of two tokens, large ones scan the lists, the boundary by cost. Sizes and places of tokens leave
       few pairs (`_pairs`), which are confirmed. So every link is confirmed or lies inside a group already.

    Tokens are counted over all texts, and ordered by level (`LEVELS`), then by hash; any order gives the same links. Null or
    empty texts, and texts without words, have an empty set and link with nothing. A null doc_id links with nothing and has
    a null component. Rows that repeat a doc_id count as one document; where they have different texts, it is linked to what
    any of them is linked to. Very long texts are compared whole. Other columns are not looked at. No rows: no rows.
    """
    rows, sketches, nodes = _nodes(docs, shingle, percent, key, text)
    lists = _lists(_may_link(nodes, percent))
    near = _can_reach(percent, F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place"), F.lit(1))
    to_hub = lists.filter(F.col("node") != F.col("hub.node")).filter(near).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    linked = _confirmed(to_hub, rows, nodes, shingle, percent)
    known = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0")
    labels = shared.written(components(linked.unionByName(_same_id(known, nodes))), "components")
    placed = lists.drop("holders", "hub").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    buckets = _buckets(placed, percent, boundary)
    more = _confirmed(_pairs(buckets, percent), rows, nodes, shingle, percent)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    joined = components(between).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    named = nodes.select("k1", "k2", "node").join(labels, "node", "left").withColumn("part", F.coalesce("component", "node"))
    named = named.join(joined, "part", "left").select("k1", "k2", F.coalesce("whole", "part").alias("class"))

    # empty texts, which may be many, have no class and take no part in the join
    held = sketches.filter("n_shingles > 0").select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left").select("doc_id", "n_shingles", "class")
    out = held.unionByName(sketches.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class")))
    for done in (lists, buckets):
        shared.discard(done)
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(shared.table(spark, sf_dir, "documents"), shingle=4, percent=85)
