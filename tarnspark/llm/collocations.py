"""Collocations: phrases whose words stand together more often than those words' own counts let expect."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Code points that end a piece of text, and those that part its words.
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bits of the filter of frequent pairs: eight for each pair, so many at least and at most. A full one lets more phrases
#: through to the count, and the result is the same.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Bytes of text whose phrases are counted together before they become rows.
BLOCK = 3 << 20

_BREAK, _BETWEEN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True
_BETWEEN[list(BREAKS + GAPS)] = True
_SCHEMA = "lang string, phrase string, n_words int, f long"


def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def _pair_slots(lang: np.ndarray, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a filter for pairs of words, from the hashes of language and words."""
    with np.errstate(over="ignore"):
        h = (lang * np.uint64(0x9E3779B97F4A7C15) ^ first) * np.uint64(0xD6E8FEB86659FD93) + second
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(33)) & np.uint64(bits - 1)


class _Block:
    """The words of a block of texts: `distinct` ones, `which` of them each is, the `lang` number of each, and `joined`:
    whether a word and the next stand in one piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = shared.text_buffers(texts)
        data = np.frombuffer(data.tobytes().translate(shared.LOWER), dtype=np.uint8)
        between = _BETWEEN[data]
        start = ~between
        start[1:] &= between[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[first] = ~between[first]
        at = np.flatnonzero(start)
        row = np.searchsorted(offsets, at, side="right") - 1
        ended = np.cumsum(_BREAK[data], dtype=np.int32)[at]
        self.joined = (row[1:] == row[:-1]) & (ended[1:] == ended[:-1])
        inside = ~between
        places = (np.cumsum(inside, dtype=np.int64) - 1)[at]
        letters = data[inside]
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(places, len(letters))), pa.py_buffer(letters)]) if len(at) else pa.array([], pa.large_binary())
        coded = chunks.dictionary_encode()
        self.distinct, self.which = coded.dictionary, coded.indices.to_numpy()
        coded = langs.dictionary_encode()
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy()[row]


def _counted(block: _Block, sizes: range, frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The phrases of each size with their counts in the block; size 0 is the count of all words.

    frequent: a filter of pairs (bytes of bits); phrases that hold a pair outside it are left out."""
    n = len(block.which)
    if not n:
        return
    words = max(len(block.distinct), 1)
    if 0 in sizes:
        total = np.bincount(block.lang, minlength=len(block.langs))
        k = len(block.langs)
        yield pa.record_batch({"lang": block.langs, "phrase": pa.array([""] * k), "n_words": pa.array([0] * k, pa.int32()), "f": pa.array(total, pa.int64())})
    joined = block.joined
    if frequent is not None:
        langs, hashes = _hash([x.encode() for x in block.langs.to_pylist()]), _hash(block.distinct.to_pylist())
        slot = _pair_slots(langs[block.lang[:-1]], hashes[block.which[:-1]], hashes[block.which[1:]], 8 * len(frequent))
        joined = joined & (frequent[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    where = np.arange(n)  # where the phrases of this size begin
    key = block.lang.astype(np.int64) * words + block.which  # the number of the phrase that begins there, among those of its size
    for size in range(1, max(sizes) + 1):
        if size > 1:
            here = where[where + size - 1 < n]
            go = joined[here + size - 2]
            key, where = key[: len(here)][go], here[go]
            if not len(where):
                return
            key = key * words + block.which[where + size - 1]
        if size > 1 or size in sizes:
            _, place, key, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        if size in sizes:
            first = where[place]
            parts = [block.distinct.take(pa.array(block.which[first + k])) for k in range(size)]
            text = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
            yield pa.record_batch({"lang": block.langs.take(pa.array(block.lang[first])), "phrase": text.cast(pa.large_string()).cast(pa.string()), "n_words": pa.array(np.full(len(first), size), pa.int32()), "f": pa.array(count, pa.int64())})


def _phrases(rows: DataFrame, sizes: range, frequent: Broadcast | None = None) -> DataFrame:
    """lang, phrase, n_words, f: rows of counted phrases, summed over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if frequent is None else np.frombuffer(frequent.value, dtype=np.uint8)
        held, size = [], 0

        def count() -> Iterator[pa.RecordBatch]:
            together = pa.Table.from_batches(held).combine_chunks().to_batches()
            held.clear()
            shared.release_memory()
            for part in together:
                for out in _counted(_Block(part.column("text"), part.column("lang")), sizes, bits):
                    for low in range(0, out.num_rows, 1 << 14):
                        yield out.slice(low, 1 << 14)

        for batch in batches:
            for part in shared.blocks_of(batch, "text", BLOCK):
                held.append(part)
                size += part.nbytes
                if size >= BLOCK:
                    yield from count()
                    size = 0
        if held:
            yield from count()
        shared.release_memory()

    found = shared.map_arrow(rows, run, _SCHEMA)
    return found.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f"))


def _filter_of(pairs: DataFrame) -> bytes:
    """A filter of the pairs (lang, phrase) of two words: bits in a row, at most MOST_BITS / 8 bytes whatever the pairs."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * pairs.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                two = [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
                langs = _hash([x.encode() for x in batch.column("lang").to_pylist()])
                yield pa.record_batch({"slot": pa.array(_pair_slots(langs, _hash([a for a, _ in two]), _hash([b for _, b in two]), bits).astype(np.int64))})

    slots = shared.map_arrow(pairs.select("lang", "phrase"), run, "slot long").select((F.col("slot") + 1).alias("slot"))
    blocks = slots.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for block, found in blocks.toLocalIterator():
        low = (block - 1) * 4096
        out[low : low + 4096] |= np.frombuffer(found, dtype=np.uint8)[: len(out) - low]
    return out.tobytes()


def collocations(docs: DataFrame, *, max_words: int = 4, min_count: int = 30, covered_percent: int = 80, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to max_words words.

    1. Phrases of 0 (all words), 1 and 2 words are exploded into rows of counts and summed by language and phrase.
    2. Longer ones follow, but for those that hold a pair of words below min_count: such a phrase is below it as well, and
       so is never a candidate, a part of one, or longer than one. A filter of the frequent pairs, bounded in size, tells
       most of them; it never leaves out a phrase that counts.
    3. Candidates (a = f >= min_count) are joined with the counts l and r of their two parts at each cut; the least
       floor(2000000 * a / (l + r)), in decimals, is the score, ties to the cut after fewer words.
    4. A candidate goes if a longer one that holds it has covered_percent of its count. One word more is enough to look
       at: a phrase between the two has at least the longer one's count.
    5. The first `top` by score, count and phrase (UTF-8 byte order), first in shares of each language, then of those.

    Texts are lower-cased (A-Z), split into pieces at BREAKS and pieces into words at GAPS. A null language is `und`; null
    and empty texts hold no words. Repeated rows count again. Texts of any length are taken whole. Ties have one order, as
    a language's phrases are distinct. Other columns are not looked at. No rows, or no candidates: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = shared.written(_phrases(rows, range(0, min(max_words, 2) + 1)).filter((F.col("f") >= min_count) | (F.col("n_words") == 0)), "phrases")
    known = short
    if max_words > 2:
        frequent = spark.sparkContext.broadcast(_filter_of(short.filter("n_words = 2")))
        known = short.unionByName(shared.written(_phrases(rows, range(3, max_words + 1), frequent).filter(F.col("f") >= min_count), "phrases"))
    candidates = known.filter("n_words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    f_of = lambda part, count: known.filter("n_words > 0").select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
    part = lambda low, n: F.array_join(F.slice("words", low, n), " ")
    cut = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    cut = cut.join(f_of("first", "l"), ["lang", "first"]).join(f_of("rest", "r"), ["lang", "rest"])
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))

    longer = candidates.filter(F.size("words") > 2).select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("words") - 1), part(F.lit(2), F.size("words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    free = scored.join(longer.withColumnRenamed("most", "longer"), ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {covered_percent} * a")

    order = [F.col("best.score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    first = free.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = known.filter("n_words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(shared.table(spark, sf_dir, "documents"))
