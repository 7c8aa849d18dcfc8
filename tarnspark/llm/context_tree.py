"""Language-model scores by context-tree weighting over bytes, each byte coded as eight binary decisions.

A node is a context (the d bytes before, d = 0 to DEPTH) with the bits of the byte seen so far. Its block probability by
Krichevsky and Trofimov depends on its counts of zeros and ones alone, so training is counting: the weighted probability
of a node is half its own estimate and half the product of those of its longer contexts, from the longest up. A decision
is predicted by mixing the estimates of all depths by what each node's weights have become.

Where a longer context was never met at a decision, it has no say: the mixture ends at the longest context that was.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Bytes of context. A context and its byte are one 64-bit key: nearest byte first, the byte itself last.
DEPTH = 5
#: The end of a text, and what stands before its beginning.
END = 10
GRAM, WORD, NODE = 0, 1, 2
#: Context bytes by which grams are dealt out: a task weights the depths from there on, `Top` the rest.
DEALT = 3
#: Blocks in one row of a gram or word, at most: one that every block holds is many rows.
MOST_BLOCKS = 1000
_HALF = math.log(0.5)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(shared.LOWER).split()


def keys_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The key of each byte of each text (its words with single spaces, then END), and where each text's keys begin."""
    pad = bytes([END]) * DEPTH
    bodies = [b" ".join(w) for w in texts]
    lengths = np.array([len(b) + 1 for b in bodies], dtype=np.int64)
    data = np.frombuffer(b"".join(pad + b + bytes([END]) for b in bodies) + bytes(8), dtype=np.uint8)
    starts = np.cumsum(lengths) - lengths
    n = len(data) - 8 - DEPTH
    # the eight bytes from each place on, the last one highest: of them the context's, and the byte after it
    eight = np.ascontiguousarray(np.lib.stride_tricks.as_strided(data[:8].view("<i8"), shape=(n,), strides=(1,)))
    eight &= (1 << 8 * DEPTH) - 1
    eight <<= 8
    eight |= data[DEPTH : DEPTH + n]
    real = np.ones(n, dtype=bool)
    last = (starts + lengths + DEPTH * np.arange(len(starts)))[:-1]  # where the next text's pad begins to be predicted
    real[(last[:, None] + np.arange(DEPTH)).ravel()] = False
    return eight[real], starts


class Lookup:
    """A hash table of whole arrays: distinct keys of 0 and more, and a value for each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(1.5 * max(1, len(keys))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = at[left] + 1 & self.mask
        self.values[at] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            at[left] = at[left] + 1 & self.mask
            found = self.keys[at[left]]
            if (found == -1).any():
                raise KeyError("a gram that was not counted: the texts changed between two reads")
            left = left[found != keys[left]]
        return self.values[at]


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers, by Stirling's series eight further on."""
    y = x + 8.0
    down = np.log(x)
    for k in range(1, 8):
        down = down + np.log(x + k)
    r = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + r / 12 - r**3 / 360 + r**5 / 1260 - down


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the block probability of so many zeros and ones, in any order."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _weighted(own: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the weighted probability, and how much of it is the node's own."""
    both = np.logaddexp(_HALF + own, _HALF + longer)
    return both, np.exp(_HALF + own - both)


def subtree(keys: np.ndarray, counts: np.ndarray, shallow: int = DEALT) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, ...]]]:
    """For sorted keys with all that share a context of `shallow` bytes: what the depths from there on predict.

    Returns a row of eight for each key, the probability of each of its bits (nan where no such context was met), and for
    each of the eight levels the nodes at depth `shallow`: key prefix, zeros, ones, log weighted probability.
    """
    n = len(keys)
    predicted = np.full((n, 8), np.nan)
    now, count, to_now = keys, counts, np.arange(n)  # (context, byte) pairs at this depth; the pair of each key
    below: list[tuple[np.ndarray, np.ndarray]] = []  # of each level: log weighted probability and first pair of the nodes one depth further
    up = None  # pair at the depth before -> pair now
    for depth in range(DEPTH, shallow - 1, -1):
        here = []
        nodes: dict[int, tuple[np.ndarray, ...]] = {}
        for j in range(8):
            prefix = now >> 8 - j
            start = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            node = np.cumsum(np.append(False, prefix[1:] != prefix[:-1]))
            bit = now >> 7 - j & 1
            total = np.add.reduceat(count, start).astype(np.float64)
            ones = np.add.reduceat(count * bit, start).astype(np.float64)
            own = log_kt(total - ones, ones)
            if up is None:
                log_w, stay = own, np.ones(len(own))
            else:
                sums = np.bincount(node[up[below[j][1]]], weights=below[j][0], minlength=len(start))
                log_w, stay = _weighted(own, sums)
            at = node[to_now]
            mine = np.where(keys >> 7 - j & 1, ones[at], total[at] - ones[at])
            kt = (mine + 0.5) / (total[at] + 1.0)
            longer = predicted[:, j]
            mixed = np.where(np.isnan(longer), kt, stay[at] * kt + (1 - stay[at]) * longer)
            predicted[:, j] = np.where(total[at] > 0, mixed, np.nan)
            here.append((log_w, start))
            nodes[j] = (prefix[start], total - ones, ones, log_w)
        if depth == shallow:
            return predicted, nodes
        below = here
        # one byte of context less: the farthest, which stands just above the predicted byte
        shorter = now >> 16 << 8 | now & 255
        now, up = np.unique(shorter, return_inverse=True)
        count = np.bincount(up, weights=count, minlength=len(now)).astype(np.int64)
        to_now = up[to_now]
    raise AssertionError


def _texts(docs: DataFrame, n_blocks: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "held_out", text.alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"))


def _parts(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in table.to_batches(max_chunksize=2000):
        for part in shared.blocks_of(batch, "text", 1 << 20):
            yield part, [words_of(t) for t in part.column("text").to_pylist()]


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def _word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def _count(table: pa.Table) -> pa.Table:
    """(block, kind, key, n): how often each gram and word of a block stands in its texts to learn from; 0 if in others only."""
    grams: list[np.ndarray] = []
    times: list[np.ndarray] = []
    words: Counter = Counter()
    held: set[bytes] = set()
    for part, texts in _parts(table):
        out = np.array(part.column("held_out").to_pylist(), dtype=bool)
        keys, starts = keys_of(texts)
        learned = np.repeat(~out, np.diff(np.append(starts, len(keys))))
        a, n = np.unique(keys[learned], return_counts=True)
        b = np.unique(keys[~learned])
        grams += [a, b]
        times += [n, np.zeros(len(b), dtype=np.int64)]
        if sum(map(len, grams)) > 1_000_000:
            g, n = _merge(grams, times)
            grams, times = [g], [n]
        for skip, w in zip(out.tolist(), texts, strict=True):
            if skip:
                held.update(w)
                held.add(b"\n")
            else:
                words.update(w)
                words[b"\n"] += 1
    g, n = _merge(grams, times)
    for w in held:
        words.setdefault(w, 0)
    del grams, times, held
    shared.release_memory()
    block = table["block"][0].as_py() if table.num_rows else 0
    return pa.table(
        {
            "block": pa.array(np.full(len(g) + len(words), block), pa.int32()),
            "kind": pa.array(np.repeat([GRAM, WORD], [len(g), len(words)]), pa.int32()),
            "key": pa.array(np.append(g, np.fromiter(map(_word_key, words), dtype=np.int64, count=len(words))), pa.int64()),
            "n": pa.array(np.append(n, np.fromiter(words.values(), dtype=np.int64, count=len(words))), pa.int64()),
        }
    )


def _rows(key: np.ndarray, n: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys: the distinct ones and their sums of n; where rows of at most MOST_BLOCKS blocks each begin, and of which distinct key."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(start, append=len(key))
    pieces = -(-size // MOST_BLOCKS)
    of = np.repeat(np.arange(len(start)), pieces)
    cuts = start[of] + MOST_BLOCKS * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return key[start], np.add.reduceat(n, start), cuts, of


def _grow(batches: Iterator[pa.RecordBatch], least: int = 400_000) -> Iterator[pa.RecordBatch]:
    """From (kind, key, n, block), sorted by kind and key, whole DEALT-byte contexts: the sums of words, predictions for grams,
    and sums for the nodes one byte up. Holds `least` rows and one context at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            kind, key = table["kind"].to_numpy(), table["key"].to_numpy()
            context = np.where(kind == GRAM, key >> 8 * (DEPTH + 1 - DEALT), key)
            change = np.flatnonzero((kind[1:] != kind[:-1]) | (context[1:] != context[:-1]))
            held, size = [], 0
            if len(change):
                yield from _grown(table.slice(0, int(change[-1]) + 1))
                table = table.slice(int(change[-1]) + 1)
            for rest in table.to_batches():
                held.append(rest)
                size += rest.num_rows
            least = max(least, 2 * size)  # a context larger than that is waited for
    if size:
        yield from _grown(pa.Table.from_batches(held).combine_chunks())
    shared.release_memory()


def _grown(table: pa.Table) -> Iterator[pa.RecordBatch]:
    def lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(cuts, len(values)), pa.int32()), pa.array(values))

    none = lambda n, kind: pa.nulls(n, pa.list_(kind))
    kinds = table["kind"].to_numpy()
    for kind in (GRAM, WORD):
        own = slice(*np.searchsorted(kinds, [kind, kind + 1]))
        key, n, block = (table[c].to_numpy()[own] for c in ("key", "n", "block"))
        if not len(key):
            continue
        distinct, count, cuts, of = _rows(key, n, block)
        predicted = None
        if kind == GRAM:
            predicted, nodes = subtree(distinct, count)
            predicted = predicted.astype(np.float32)[of]
        yield pa.record_batch(
            {
                "kind": pa.array(np.full(len(of), kind, dtype=np.int32)),
                "key": pa.array(distinct[of]),
                "n": pa.array(count[of]),
                "first": pa.array(np.append(True, of[1:] != of[:-1])),
                "blocks": lists(block, cuts),
                "p": none(len(of), pa.float32()) if predicted is None else lists(predicted.ravel(), 8 * np.arange(len(of))),
                "sums": none(len(of), pa.float64()),
            }
        )
        if kind == GRAM:
            for j, (prefix, zeros, ones, log_w) in nodes.items():
                node = prefix >> 8 + j << 8 | 1 << j | prefix & (1 << j) - 1  # nearer bytes, then bits seen behind a leading 1
                near, where = np.unique(node, return_inverse=True)
                total = np.stack([np.bincount(where, weights=x, minlength=len(near)) for x in (zeros, ones, log_w)], axis=1)
                m = len(near)
                yield pa.record_batch({"kind": pa.array(np.full(m, NODE, dtype=np.int32)), "key": pa.array(near), "n": pa.nulls(m, pa.int64()), "first": pa.nulls(m, pa.bool_()), "blocks": none(m, pa.int32()), "p": none(m, pa.float32()), "sums": lists(total.ravel(), 3 * np.arange(m))})


class Top:
    """The nodes of depths 2, 1 and 0, made from the sums over all longer contexts, in double precision.

    There are at most 255 for each pair of bytes that occurs, so 16 million whatever the corpus; text has some hundred thousand.
    """

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray):
        pairs = np.unique(keys >> 8)
        self.pair = np.zeros(1 << 16, dtype=np.int32)
        self.pair[pairs] = np.arange(len(pairs))
        self.depths = []  # from depth 2 on: probability of a zero and of a one, and how much of the mixture is the node's own
        at, size = self.pair[keys >> 8].astype(np.int64) << 8 | keys & 255, max(1, len(pairs)) << 8
        for depth in (2, 1, 0):
            zeros, ones, longer = (np.bincount(at, weights=x, minlength=size) for x in (zeros, ones, longer))
            log_w, stay = _weighted(log_kt(zeros, ones), longer)
            total = zeros + ones
            self.depths.append([np.where(total > 0, (x + 0.5) / (total + 1.0), np.nan) for x in (zeros, ones)] + [stay])
            longer = np.where(total > 0, log_w, 0.0)
            if depth == 2:  # of the two bytes only the nearer one stays
                at, size = np.repeat(np.append(pairs, 0)[: max(1, len(pairs))] >> 8, 256) << 8 | np.arange(size) & 255, 1 << 16
            else:
                at, size = np.arange(size) & 255, 256

    def log10(self, keys: np.ndarray, predicted: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's byte; predicted: of its bits, by depths DEALT and more."""
        out = np.zeros(len(keys))
        pair = self.pair[keys >> 8 * (DEPTH - 1)].astype(np.int64) << 8
        near = keys >> 8 * DEPTH << 8
        for j in range(8):
            bits, bit = 1 << j | (keys & 255) >> 8 - j, (keys >> 7 - j & 1).astype(bool)
            p = predicted[:, j].astype(np.float64)
            for at, (zero, one, stay) in zip((pair | bits, near | bits, bits), self.depths, strict=True):
                kt, own = np.where(bit, one[at], zero[at]), stay[at]
                p = np.where(np.isnan(p), kt, own * kt + (1 - own) * p)
            out += np.log10(np.where(np.isnan(p), 0.5, p))
        return out


def score(docs: DataFrame, *, block_bytes: int = 14 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of each row of docs (doc_id, text, held_out).

    Learns from the rows that aren't held out, and scores all. A text is its words (parted by ASCII white space, A-Z in
    lower case) with single spaces between, and an end; score is the log10 probability of all its bytes and the end, and
    base_score that of its words and the end by add-one counts.

    1. Texts are dealt by hash into blocks of about block_bytes; each block is reduced to its distinct grams (context and
       byte) and words with counts. What is gathered grows with the texts.
    2. Grams are dealt by their nearest three context bytes and sorted, so that a task sums equal ones and weights whole
       subtrees of distinct grams from the longest contexts up, one context after another; sums for the nodes at depth 2
       (bounded, see `Top`) go to the driver in double precision.
    3. Each block gets back the values of its own grams and words, and scores its texts.

    No model is broadcast but the nodes of depths 0 to 2. n_bytes counts the bytes of a text so written with its end, and
    bits_per_byte is its code length over them. A null or empty text is its end alone. Null doc_ids and repeated rows are
    rows like others. Without rows to learn from each bit costs one bit. No rows: no rows.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    n_blocks = max(1, math.ceil(shared.text_bytes(docs) / block_bytes))
    texts = _texts(docs, n_blocks)
    counted = texts.groupBy("block").applyInArrow(_count, "block int, kind int, key long, n long")
    context = F.when(F.col("kind") == GRAM, F.shiftright("key", 8 * (DEPTH + 1 - DEALT))).otherwise(F.col("key"))
    dealt = counted.repartition(max(n_blocks, shared.parts_for(spark, 0, 1)), "kind", context).sortWithinPartitions("kind", "key")
    grown = shared.map_arrow(dealt.select("kind", "key", "n", "block"), _grow, "kind int, key long, n long, first boolean, blocks array<int>, p array<float>, sums array<double>")
    grown = shared.written(grown, "subtrees")
    word_sums = grown.filter(f"kind = {WORD} AND first").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_train, vocabulary = word_sums.n or 0, word_sums.v or 0
    sums = grown.filter(f"kind = {NODE}").groupBy("key").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(3)]).toArrow()
    top = Top(*(sums[c].to_numpy() for c in ("key", "s0", "s1", "s2")))  # one row a node of depth 2
    base = math.log10(n_train + vocabulary + 1)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            predicted = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, 8)
            yield pa.record_batch({"key": batch.column("key"), "blocks": batch.column("blocks"), "value": pa.array(top.log10(key, predicted))})

    grams = shared.map_arrow(grown.filter(f"kind = {GRAM}").select("key", "blocks", "p"), value, "key long, blocks array<int>, value double")
    grams = grams.select(F.explode("blocks").alias("block"), F.lit(GRAM).alias("kind"), "key", "value")
    words = grown.filter(f"kind = {WORD}").select(F.explode("blocks").alias("block"), "kind", "key", F.col("n").cast("double").alias("value"))

    def apply(table: pa.Table, values: pa.Table) -> pa.Table:
        kind = values["kind"].to_numpy()
        key, known = values["key"].to_numpy(), values["value"].to_numpy()
        of_gram = Lookup(key[kind == GRAM], known[kind == GRAM])
        of_word = Lookup(key[kind == WORD], np.log10(known[kind == WORD] + 1) - base)
        del kind, key, known, values
        out = []
        for part, texts in _parts(table):
            keys, starts = keys_of(texts)
            totals = np.add.reduceat(of_gram(keys), starts)
            distinct = list({b"\n"}.union(*texts))
            costs = of_word(np.fromiter(map(_word_key, distinct), dtype=np.int64, count=len(distinct)))
            cost, unknown = dict(zip(distinct, costs.tolist(), strict=True)), -base
            for k, w in enumerate(texts):
                each = [cost[x] for x in (*w, b"\n")]
                size = sum(map(len, w)) + max(1, len(w))
                out.append((len(each), sum(e > unknown for e in each), math.fsum(each), totals[k], size, -totals[k] * math.log2(10) / size))
        fields = list(zip(*out, strict=True)) if out else [[]] * 6
        del of_gram, of_word
        shared.release_memory()
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "held_out": table["held_out"],
                "n_tokens": pa.array(fields[0], pa.int64()),
                "n_known": pa.array(fields[1], pa.int64()),
                "train_tokens": pa.array([n_train] * len(out), pa.int64()),
                "base_score": pa.array(fields[2], pa.float64()),
                "score": pa.array(fields[3], pa.float64()),
                "n_bytes": pa.array(fields[4], pa.int64()),
                "bits_per_byte": pa.array(fields[5], pa.float64()),
            }
        )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return texts.groupBy("block").cogroup(grams.unionByName(words).groupBy("block")).applyInArrow(apply, out)


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score(shared.table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out")))
