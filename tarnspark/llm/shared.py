"""What the operators of this subpackage share: tables, written stages, and the chunk encoder."""

from __future__ import annotations

import contextlib
import ctypes
import math
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.functions.folders import new_path
from tarnspark.functions.shipping import ship

#: Code points that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of the filter on document ids: at least eight for each id sought, and no filter beyond the most, which take 128 MB.
FILTER_BITS, MOST_FILTER_BITS = 1 << 23, 1 << 30
#: Rows of a batch that goes to Python.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: A to Z to lower case, as bytes; other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_GAP_TABLE = np.zeros(256, dtype=bool)
_GAP_TABLE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage ends there and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tarnspark_path = path
    return out


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a string column, for choosing how many partitions to deal it over."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first().n or 0


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has in no case: name, with as many _ before it as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def maybe_in(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key may be among `ids` (one column), by a bitmap of key hashes that is broadcast: eight bits
    an id, or none at all where that would pass MOST_FILTER_BITS. A row that is kept in error is left to the join that
    follows; none is dropped in error."""
    wanted = max(FILTER_BITS, 1 << (8 * ids.count()).bit_length())
    if wanted > MOST_FILTER_BITS:
        return docs
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(wanted)) + 1
    bits = ids.select(slot(F.col(ids.columns[0])).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits"))
    at = F.bitmap_bit_position(slot(F.col(key)))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("_bucket", F.bitmap_bucket_number(slot(F.col(key)))).join(F.broadcast(bits), "_bucket")
    return found.filter(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*docs.columns)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by `written` that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_tarnspark_path", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def prepare(spark: SparkSession) -> None:
    """Before Arrow batches: this package on the executors, and batches of BATCH_ROWS in sessions that set no number of their own.

    Texts of a few thousand characters fill tens of MB in Spark's usual batch, held by the JVM and the worker at once.
    Plans read the setting when they run, so it stays set.
    """
    ship(spark)
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, BATCH_ROWS)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, prepared for."""
    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def parts_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    """So many partitions that each holds about `each` bytes, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / each))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (nulls as empty) and the offset of each value, one more than values."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks_of(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `limit` bytes of text each, one row at least. All rows are in some slice."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


#: ASCII marks that neither join a letter to a word nor stand in a special token or a contraction.
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b'.,;:!?()"-#*$%&+/=@[]{}^~')] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def mark_borders(data: np.ndarray) -> np.ndarray:
    """True at each byte, but for the first, where a mark and an ASCII letter meet."""
    mark, letter = _MARK[data], _LETTER[data]
    return mark[1:] & letter[:-1] | letter[1:] & mark[:-1]


def word_starts(data: np.ndarray) -> np.ndarray:
    """True where a word begins after white space, or a mark and a letter meet."""
    gap = _GAP_TABLE[data]
    start = ~gap
    start[1:] &= gap[:-1] | mark_borders(data)
    return start


class KeyTable:
    """A hash table of whole arrays: the numbers 0, 1, 2 and so on for pairs of 64-bit numbers, in the order they come.

    Slots hold numbers and are probed one after another; the pairs themselves are compared, so no two are taken for one.
    """

    def __init__(self):
        self.n, self.bits = 0, 17
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.low, self.high = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.uint64)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (low ^ (high >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + high
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each pair, -1 for strangers."""
        slot = self._slot(low, high)
        out = self.slots[slot]
        left = np.flatnonzero((out >= 0) & ((self.low[out] != low) | (self.high[out] != high)))
        mask = len(self.slots) - 1
        while len(left):
            slot[left] = slot[left] + 1 & mask
            found = self.slots[slot[left]]
            out[left] = found
            left = left[(found >= 0) & ((self.low[found] != low[left]) | (self.high[found] != high[left]))]
        return out

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        """Takes in distinct strangers."""
        n = self.n + len(low)
        if n > len(self.low):
            self.low, self.high = (np.append(x, np.zeros(max(n, 3 * len(x) // 2) - len(x), dtype=np.uint64)) for x in (self.low, self.high))
        self.low[self.n : n], self.high[self.n : n] = low, high
        first, self.n = self.n, n
        if 2 * n > len(self.slots):
            self.bits, first = int(3 * n).bit_length(), 0
            self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(first, n, dtype=np.int32)
        slot = self._slot(self.low[first:n], self.high[first:n])
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left  # taken before, or by another of these
            left, slot = left[lost], slot[lost] + 1 & len(self.slots) - 1


class ChunkEncoder:
    """Encodes texts chunk by chunk; each distinct chunk is encoded once and then looked up.

    `starts` marks the bytes at which a text may be cut without changing its ids; `encode` turns a list of chunks
    (bytes) into how many ids each has and all their ids in a row. Texts are cut at those bytes only, so the ids are
    those of the whole text. `drops` marks bytes, by value, that have no ids and are taken out of chunks first.

    Chunks of SHORT bytes or fewer are looked up in whole arrays, as numbers that hold all their bytes and their length;
    longer ones in a dictionary. About `keep` chunks (and long_bytes of long ones) are remembered; beyond that it starts
    anew. table: bytes that others go to first, as in bytes.translate, but where a block of texts holds `unless`.
    """

    SHORT, STEP = 15, 1 << 16

    def __init__(
        self,
        starts: Callable[[np.ndarray], np.ndarray],
        encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
        keep: int = 1_000_000,
        long_bytes: int = 16 << 20,
        drops: np.ndarray | None = None,
        table: bytes | None = None,
        unless: bytes | None = None,
    ):
        self.starts, self.encode, self.keep, self.long_bytes, self.drops, self.table, self.unless = starts, encode, keep, long_bytes, drops, table, unless
        self._forget()

    def _forget(self) -> None:
        self.short, self.long, self.long_used = KeyTable(), {}, 0
        self.number = np.zeros(1 << 16, dtype=np.int32)  # of each short chunk among all chunks known
        self.n, self.used = 0, 0
        self.length, self.flat = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 18, dtype=np.uint16)
        self.first = np.zeros(1 << 16, dtype=np.int64)

    @staticmethod
    def _room(a: np.ndarray, n: int, kind: np.dtype | None = None) -> np.ndarray:
        kind = kind or a.dtype
        if n <= len(a) and kind == a.dtype:
            return a
        out = np.zeros(max(n, 3 * len(a) // 2), dtype=kind)
        out[: len(a)] = a
        return out

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """Encodes new chunks; their numbers."""
        length, ids = self.encode(chunks)
        n = self.n + len(chunks)
        self.length, self.first = self._room(self.length, n), self._room(self.first, n)
        self.length[self.n : n] = length
        self.first[self.n : n] = self.used + np.cumsum(length) - length
        wide = np.uint32 if self.flat.dtype == np.uint32 or (len(ids) and ids.max() > 0xFFFF) else np.uint16
        self.flat = self._room(self.flat, self.used + len(ids), np.dtype(wide))
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        out, self.n = np.arange(self.n, n, dtype=np.int32), n
        return out

    def _numbers(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each chunk (its place and size in data) among the known ones; unknown ones are encoded."""
        if self.n > self.keep or self.long_used > self.long_bytes:
            self._forget()
        raw = data.tobytes()
        padded = np.frombuffer(raw + bytes(16), dtype=np.uint8)
        eight = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(raw) + 8,), strides=(1,)))
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
        all_short = size.max() <= self.SHORT
        short = slice(None) if all_short else np.flatnonzero(size <= self.SHORT)
        a, n = at[short], size[short]
        low = eight[a] & mask[np.minimum(n, 8)]
        high = eight[np.minimum(a + 8, len(raw))] & mask[np.maximum(n - 8, 0)] | n.astype(np.uint64) << np.uint64(56)
        del eight
        found = self.short.find(low, high)
        if len(missing := np.flatnonzero(found < 0)):
            order = missing[np.lexsort((low[missing], high[missing]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            first, before = order[new], self.short.n
            found[order] = before + np.cumsum(new, dtype=np.int32) - 1
            self.short.add(low[first], high[first])
            self.number = self._room(self.number, self.short.n)
            self.number[before : self.short.n] = self._learn([raw[x : x + k] for x, k in zip(a[first].tolist(), n[first].tolist(), strict=True)])
        if all_short:
            return self.number[found]
        out = np.empty(len(at), dtype=np.int32)
        out[short] = self.number[found]
        rest = np.flatnonzero(size > self.SHORT)
        chunks = [raw[x : x + k] for x, k in zip(at[rest].tolist(), size[rest].tolist(), strict=True)]
        if strange := list(dict.fromkeys(c for c in chunks if c not in self.long)):
            self.long.update(zip(strange, self._learn(strange).tolist(), strict=True))
            self.long_used += sum(map(len, strange))
        out[rest] = [self.long[c] for c in chunks]
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all values in a row (uint32), and the offset of each value's ids, one more than values."""
        data, offsets = text_buffers(column)
        if self.table and len(data):
            raw = data.tobytes()
            if not self.unless or self.unless not in raw:
                data = np.frombuffer(raw.translate(self.table), dtype=np.uint8)
        start = self.starts(data) if len(data) else np.zeros(0, dtype=bool)
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[first] = True if self.drops is None else ~self.drops[data[first]]
        at = np.flatnonzero(start)
        if not len(at):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        out, ends = [], np.zeros(len(at) + 1, dtype=np.int64)
        for low in range(0, len(at), self.STEP):  # some at a time: what is made on the way takes a dozen times their bytes
            place = at[low : low + self.STEP]
            piece = data[place[0] : at[low + self.STEP] if low + self.STEP < len(at) else len(data)]
            place = place - place[0]
            if self.drops is not None:
                stays = ~self.drops[piece]
                place, piece = np.cumsum(stays)[place] - 1, piece[stays]
            number = self._numbers(piece, place, np.diff(place, append=len(piece)))
            length = self.length[number]
            end = np.cumsum(length, dtype=np.int64)
            out.append(self.flat[np.repeat(self.first[number] - end + length, length) + np.arange(end[-1])].astype(np.uint32))
            ends[low + 1 : low + 1 + len(number)] = ends[low] + end
        return np.concatenate(out), ends[np.searchsorted(at, offsets)]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> ChunkEncoder:
    """The tokenizers library's ids for the lower-casing tokenizer that drops white space, chunk by chunk.

    Its normaliser (NFC, white space, lower case) and its pre-tokeniser (letters, single digits, other marks) never reach
    across ASCII white space or across a border of an ASCII letter and a mark of _MARK (no such mark before a letter
    composes with it, and no contraction or special token holds one), so a text's ids are those of its chunks in turn.
    Each worker process keeps one.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    between = tokenizer.encode("\x01", add_special_tokens=False).ids  # no other text has this id

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # many chunks go as one text, parted by a character of its own; those that hold it go one by one
        odd = [k for k, c in enumerate(chunks) if b"\x01" in c]
        if odd or len(between) != 1:
            each = [x.ids for x in tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
            return np.fromiter(map(len, each), dtype=np.int32, count=len(each)), np.fromiter(chain.from_iterable(each), dtype=np.uint32)
        texts = (b" \x01 ".join(chunks[a : a + 400]).decode() + " \x01" for a in range(0, len(chunks), 400))
        ids = np.fromiter(chain.from_iterable(tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in texts), dtype=np.uint32)
        stop = np.flatnonzero(ids == between[0])
        return np.diff(stop, prepend=-1).astype(np.int32) - 1, np.delete(ids, stop)

    # the tokenizer goes to lower case anyway; but a special token in capitals would become one
    return ChunkEncoder(word_starts, encode, drops=_GAP_TABLE, table=LOWER, unless=b"<|")


#: Words of letters, digits and code points beyond ASCII, lower case: other ASCII bytes become spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain_bytes(text: bytes) -> bytes:
    """A-Z to lower case, and a space for each ASCII character that is no letter and no digit."""
    return text.translate(_PLAIN)


def by_word(encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], keep: int = 1_000_000) -> ChunkEncoder:
    """Encodes texts by their words of letters, digits and code points beyond ASCII, in lower case as far as ASCII goes. keep: as in ChunkEncoder."""

    def starts(data: np.ndarray) -> np.ndarray:
        gap = _GAP_TABLE[data]
        start = ~gap
        start[1:] &= gap[:-1]
        return start

    return ChunkEncoder(starts, encode, keep, drops=_GAP_TABLE, table=_PLAIN)


class Words:
    """The words of a block of texts: `distinct` words as bytes, `which` of them each word is, and the `row` it stands in."""

    def __init__(self, column: pa.Array, plain: bool):
        """plain: words of `plain_bytes`; else words parted by ASCII white space, A-Z to lower case."""
        data, self.offsets = text_buffers(column)
        self.data = np.frombuffer(data.tobytes().translate(_PLAIN if plain else LOWER), dtype=np.uint8)
        n = len(self.offsets) - 1
        gap = _GAP_TABLE[self.data]
        start = ~gap
        start[1:] &= gap[:-1]
        first = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        start[first] = ~gap[first]
        self.at = np.flatnonzero(start).astype(np.int64)
        self.before = np.searchsorted(self.at, self.offsets)  # words before each row
        self.row = np.repeat(np.arange(n), np.diff(self.before))
        if not len(self.at):
            self.distinct, self.which = [], np.zeros(0, dtype=np.int32)
            return
        # a word's chunk ends where the next begins: white space after it is cut off afterwards
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.at), [None, pa.py_buffer(np.append(self.at, len(self.data))), pa.py_buffer(self.data)])
        coded = chunks.dictionary_encode()
        words = [w.rstrip(b" \t\n\x0b\x0c\r") for w in coded.dictionary.to_pylist()]
        place: dict[bytes, int] = {}
        again = np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int32, count=len(words))
        self.distinct, self.which = list(place), again[coded.indices.to_numpy()]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.before)
