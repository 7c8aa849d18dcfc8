"""Sorted-string-table shards of token ids, keyed by document id.

A shard is one file of records; each record ends with a line feed, so Spark's text writer can write it on any file
system, with its commit protocol. The records: data blocks, then one block index, one Bloom filter and one footer.

- Data block: entries (varint shared key bytes, varint other key bytes, varint value bytes, key rest, value), a u32
  offset for each restart point (every RESTART entries; there the key stands whole), their u32 count, a u32 CRC-32.
- Index: for each block its last key, offset and length, as varint-sized fields.
- Bloom filter: u32 bits, u8 probes, the bit array.
- Footer, FOOTER_BYTES with the line feed, big-endian: u64 offset and length of index and filter, u64 entries, u64 ids in all
  values, u8 bytes an id, padding, magic.

Keys are 8 big-endian bytes with the sign turned over, so that byte order is number order; a null id is the empty key,
before all others. Values are little-endian ids, two bytes each where the vocabulary allows it.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

RESTART = 16
BLOCK_BYTES = 32 << 10
BITS_A_KEY, PROBES = 10, 7
MAX_BROADCAST_SHARDS = 100_000
MAGIC = b"TSST\x01"
_FOOTER = struct.Struct(">QQQQQQB9x5s")
FOOTER_BYTES = _FOOTER.size + 1


def pack_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def unpack_key(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class ShardWriter:
    """Turns (key, value) pairs in key order into the records of one shard. Memory: one block, the index and 8 bytes a key."""

    def __init__(self, id_bytes: int):
        self.id_bytes, self.offset, self.entries, self.ids = id_bytes, 0, 0, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def _record(self, data: bytes) -> bytes:
        self.offset += len(data) + 1
        return bytes(data)

    def _close_block(self) -> bytes:
        tail = np.array([*self.restarts, len(self.restarts)], dtype="<u4").tobytes()
        body = bytes(self.block) + tail
        body += struct.pack("<I", zlib.crc32(body))
        self.index.append((self.last, self.offset, len(body)))
        self._new_block()
        return self._record(body)

    def add(self, key: bytes, value: bytes) -> Iterator[bytes]:
        shared_bytes = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            most = min(len(key), len(self.last))
            while shared_bytes < most and key[shared_bytes] == self.last[shared_bytes]:
                shared_bytes += 1
        self.block += _varint(shared_bytes) + _varint(len(key) - shared_bytes) + _varint(len(value)) + key[shared_bytes:] + value
        self.last, self.n = key, self.n + 1
        self.entries += 1
        self.ids += len(value) // self.id_bytes
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            yield self._close_block()

    def finish(self) -> Iterator[bytes]:
        if self.n:
            yield self._close_block()
        index_at = self.offset
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        yield self._record(index)
        bits = max(64, BITS_A_KEY * len(self.keys))
        marks = np.zeros((bits + 7) // 8 * 8, dtype=bool)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.keys), dtype=np.uint64, count=len(self.keys))
        a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        for k in range(PROBES):
            marks[(a + np.uint64(k) * b) % np.uint64(bits)] = True
        bloom = struct.pack("<IB", bits, PROBES) + np.packbits(marks, bitorder="little").tobytes()
        bloom_at = self.offset
        yield self._record(bloom)
        yield self._record(_FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.entries, self.ids, self.id_bytes, MAGIC))


class Shard:
    """Reads a shard from its bytes (or anything that slices like bytes)."""

    def __init__(self, data: bytes | memoryview):
        self.data = data
        index_at, index_n, bloom_at, bloom_n, self.entries, self.ids, self.id_bytes, magic = _FOOTER.unpack(data[-FOOTER_BYTES:-1])
        if magic != MAGIC:
            raise ValueError("not a shard")
        index, at = bytes(data[index_at : index_at + index_n]), 0
        self.last_keys, self.blocks = [], []
        while at < len(index):
            n, at = _read_varint(index, at)
            self.last_keys.append(index[at : at + n])
            offset, at = _read_varint(index, at + n)
            length, at = _read_varint(index, at)
            self.blocks.append((offset, length))
        self.bloom = bytes(data[bloom_at : bloom_at + bloom_n])
        self.bits = struct.unpack("<I", self.bloom[:4])[0]

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[5 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def _block(self, k: int) -> tuple[bytes, np.ndarray]:
        offset, length = self.blocks[k]
        body = bytes(self.data[offset : offset + length])
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        n = struct.unpack("<I", body[-8:-4])[0]
        return body[: -8 - 4 * n], np.frombuffer(body[-8 - 4 * n : -8], dtype="<u4")

    @staticmethod
    def _entries(block: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(block):
            same, at = _read_varint(block, at)
            rest, at = _read_varint(block, at)
            size, at = _read_varint(block, at)
            key = key[:same] + block[at : at + rest]
            at += rest
            yield key, block[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self._entries(self._block(k)[0], 0)

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key: Bloom filter, binary search of the index, then of the block's restart points."""
        out: list[bytes] = []
        if not self.entries or not self.may_hold(key):
            return out
        for k in range(bisect_left(self.last_keys, key), len(self.blocks)):
            block, restarts = self._block(k)
            low, high = 0, len(restarts) - 1
            while low < high:  # the last restart point whose key is below the one sought
                mid = (low + high + 1) // 2
                if next(self._entries(block, int(restarts[mid])))[0] < key:
                    low = mid
                else:
                    high = mid - 1
            for found, value in self._entries(block, int(restarts[low])):
                if found > key:
                    return out
                if found == key:
                    out.append(value)
        return out


def encode_documents(batches: Iterable[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For slices of (doc_id, text) batches: the slice, all its ids with end_id after each document, and the offsets."""
    encode = shared.word_bpe(tokenizer)
    for batch in batches:
        for part in shared.blocks_of(batch, "text", 2 << 20):
            ids, offsets = encode(part.column("text"))
            ids = np.insert(ids, offsets[1:], end_id)
            yield part, ids, offsets + np.arange(len(offsets))
    shared.release_memory()


def write_shards(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", shard_bytes: int = 16 << 20, vocabulary: int = 1 << 16) -> None:
    """Writes docs as shards under path, in ascending key order across and within shards; about shard_bytes of text each.

    One range shuffle of the texts; ids are made after it. Null texts count as empty (the end id alone); a null key goes
    first. Rows of equal key go by the hash of their text, so one key may span shards. No rows: no shards.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    parts = shared.parts_for(docs.sparkSession, shared.text_bytes(rows), shard_bytes)
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(np.dtype(kind).itemsize)
        out: list[bytes] = []
        for part, ids, offsets in encode_documents(batches, tokenizer, end_id):
            ids = ids.astype(kind)
            for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                out.extend(writer.add(pack_key(doc_id), ids[offsets[k] : offsets[k + 1]].tobytes()))
            if out:
                yield pa.record_batch({"record": pa.array(out, pa.binary())})
                out = []
        if writer.entries:
            yield pa.record_batch({"record": pa.array([*writer.finish()], pa.binary())})

    packed = shared.map_arrow(dealt.select("doc_id", "text"), pack, "record binary")
    packed.select(F.col("record").cast("string")).write.option("compression", "none").text(path)


def _with_starts(counts: DataFrame) -> DataFrame:
    """counts (shard, n_ids, ...) with start, the ids of all shards before it: by the number in the name, which has more than
    five digits where there are many shards."""
    before = Window.orderBy(F.regexp_extract("shard", r"^part-(\d+)", 1).cast("bigint"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def shards(spark: SparkSession, path: str) -> DataFrame:
    """shard (file name), footer fields n_entries and n_ids, start (ids of all shards before it): one row a shard, read by Spark alone."""
    number = "conv(hex(substring(footer, {}, 8)), 16, 10)"
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    footers = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), F.expr(f"substring(content, length(content) - {FOOTER_BYTES - 1}, {FOOTER_BYTES})").alias("footer"))
    return _with_starts(footers.select("shard", F.expr(number.format(33)).cast("bigint").alias("n_entries"), F.expr(number.format(41)).cast("bigint").alias("n_ids")))


def read_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """All documents of the shards: shard, doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian 32-bit numbers), and ids (array) unless with_ids is false.

    Without ids each shard is read once: what is found in it is written, and the shards' sums are taken from there. With
    ids, sums come from the footers, so that ids needn't be written again.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                shard, before = Shard(memoryview(data.as_buffer())), 0
                rows: list = []
                size = 0
                for key, value in shard.scan():
                    n = len(value) // shard.id_bytes
                    rows.append((unpack_key(key), before, n, value))
                    before, size = before + n, size + len(value)
                    if size >= 1 << 20:
                        yield out(name, rows, shard.id_bytes)
                        rows, size = [], 0
                if rows:
                    yield out(name, rows, shard.id_bytes)

    def out(name: str, rows: list, width: int) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(r[3] for r in rows), dtype=f"<u{width}")
        ends = np.cumsum([0] + [r[2] for r in rows], dtype=np.int64)
        columns = {
            "shard": pa.array([name] * len(rows)),
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "at": pa.array([r[1] for r in rows], pa.int64()),
            "n_tokens": pa.array([r[2] for r in rows], pa.int64()),
            "ids_crc32": pa.array(ids_crc32(ids, ends), pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.record_batch(columns)

    own = ", ids array<int>" if with_ids else ""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    rows = shared.map_arrow(files, scan, f"shard string, doc_id long, at long, n_tokens long, ids_crc32 long{own}")
    if with_ids:
        starts = shared.written(shards(spark, path), "shards")
    else:
        rows = shared.written(rows, "entries")
        starts = shared.written(_with_starts(rows.groupBy("shard").agg(F.sum("n_tokens").alias("n_ids"))), "shards")
    if starts.count() <= MAX_BROADCAST_SHARDS:  # one small row a shard
        starts = F.broadcast(starts)
    rows = rows.join(starts.select("shard", F.col("start").alias("shard_start")), "shard")
    return rows.select("shard", "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def lookup(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """doc_id and ids of the given keys (a short list), by Bloom filter and binary search in each shard."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                shard = Shard(memoryview(data.as_buffer()))
                rows = [(k, np.frombuffer(v, dtype=f"<u{shard.id_bytes}").tolist()) for k in keys for v in shard.get(pack_key(k))]
                if rows:
                    yield pa.record_batch({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "ids": pa.array([r[1] for r in rows], pa.list_(pa.int32()))})

    return shared.map_arrow(spark.read.format("binaryFile").load(path).filter("length > 0").select("content"), find, "doc_id long, ids array<int>")


def ids_crc32(ids: np.ndarray, offsets: np.ndarray) -> list[int]:
    data = np.ascontiguousarray(ids.astype("<u4")).data.cast("B")
    return [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "shards")
    write_shards(shared.table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=2)

    return read_shards(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")
