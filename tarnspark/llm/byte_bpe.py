"""Byte-level BPE: whole pre-tokens by a minimal perfect hash of the vocabulary, the rest by merges over a linked list with a heap."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """A minimal perfect hash of n byte strings onto 0..n-1, by hashing and displacing.

    Keys fall into buckets of about three; from the largest bucket on, each takes the first displacement that sends all
    its keys to free slots. A bucket of one key takes any free slot, written down as such. One 64-bit hash a key gives
    bucket and slot; the stored key tells members from strangers.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 3)
        self.keys: list[bytes] = [b""] * n
        self.place = np.zeros(n, dtype=np.int64)  # of each given key
        h = self._hash(keys)
        bucket = (h >> np.uint64(40)) % np.uint64(self.buckets)
        self.shift = np.zeros(self.buckets, dtype=np.uint64)
        self.direct = np.full(self.buckets, -1, dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1, dtype=np.uint64))
        free = np.ones(n, dtype=bool)
        sizes = np.diff(cuts)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1].tolist():
            own = order[cuts[b] : cuts[b + 1]]
            d, step, found = 0, 16, False
            while not found:
                slots = self._slot(h[own][None, :], np.arange(d, d + step, dtype=np.uint64)[:, None])
                for k in np.flatnonzero(free[slots].all(axis=1)).tolist():
                    if len(set(slots[k].tolist())) == len(own):
                        self.shift[b], found = d + k, True
                        free[slots[k]] = False
                        self.place[own] = slots[k]
                        break
                d, step = d + step, min(4 * step, 1024)
        ones = by_size[sizes[by_size] == 1]
        self.direct[ones] = np.flatnonzero(free)[: len(ones)]
        self.place[order[cuts[ones]]] = self.direct[ones]
        for k, s in zip(keys, self.place.tolist(), strict=True):
            self.keys[s] = k

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))

    def _slot(self, h: np.ndarray, d: np.ndarray | np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = h ^ ((d + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            return ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; -1 for strangers."""
        if not keys or not self.n:
            return np.full(len(keys), -1, dtype=np.int64)
        h = self._hash(keys)
        bucket = ((h >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
        slot = np.where(self.direct[bucket] >= 0, self.direct[bucket], self._slot(h, self.shift[bucket]))
        own = self.keys
        same = np.fromiter((own[s] == k for s, k in zip(slot.tolist(), keys, strict=True)), dtype=bool, count=len(keys))
        return np.where(same, slot, -1)


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: the adjacent pair of lowest rank is merged, the leftmost first, until none is left.

    Parts are a linked list over byte positions, pairs a heap with stale entries left in it: n log n for n bytes.
    """
    n = len(token)
    end = list(range(1, n + 1))  # of the part that starts here; 0: merged into one before
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(token[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(token[j:stop])) is not None:
            heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = end[i]
    return out


def _cuts(data: np.ndarray) -> np.ndarray:
    """True at a single space between two characters that surely aren't white space, and where an ASCII letter and a mark that
    is no apostrophe meet: there a new pre-token always begins.

    At spaces, beside ASCII only two-byte letters are looked through (lead byte C3 to DF); elsewhere the text isn't cut.
    """
    out = np.zeros(len(data), dtype=bool)
    if len(data) < 3:
        return out
    out[1:] = shared.mark_borders(data)
    solid = (data > 0x20) & (data < 0x7F)
    lead = (data >= 0xC3) & (data <= 0xDF)
    ends = solid.copy()
    ends[1:] |= lead[:-1]
    out[1:-1] |= (data[1:-1] == 0x20) & ends[:-2] & (solid | lead)[2:]
    return out


class ByteBPE:
    """Encodes and decodes by a rank file and a split pattern, with the ids that merging each pattern match gives."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern)
        self.whole = PerfectHash(list(self.ranks))
        self.id_at = np.zeros(len(self.ranks), dtype=np.int64)
        self.id_at[self.whole.place] = list(self.ranks.values())
        top = max(self.ranks.values(), default=-1) + 1
        tokens: list[bytes] = [b""] * top
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.chunked = shared.ChunkEncoder(_cuts, self.encode_chunks)

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and all ids in a row."""
        parts = [self.split.findall(c.decode()) for c in chunks]
        distinct = list({p for x in parts for p in x})
        as_bytes = [p.encode() for p in distinct]
        slots = self.whole.find(as_bytes)
        known = {p: [int(self.id_at[s])] if s >= 0 else merge(b, self.ranks) for p, b, s in zip(distinct, as_bytes, slots.tolist(), strict=True)}
        each = [list(chain.from_iterable(map(known.__getitem__, x))) for x in parts]
        return np.fromiter(map(len, each), dtype=np.int32, count=len(each)), np.fromiter(chain.from_iterable(each), dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids in a row, and the offset of each id's bytes, one more than ids."""
        taken = self.tokens.take(pa.array(ids.astype(np.int64)))
        offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1]
        return memoryview(taken.buffers()[2] or b""), offsets


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBPE:
    """One for each worker process: its tables and what it has encoded serve all its tasks."""
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, *, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array) of each text. A null text has no ids, as an empty one. Repeated rows stay. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks, pattern)
        for batch in batches:
            for part in shared.blocks_of(batch, "text", 2 << 20):
                ids, offsets = bpe.chunked(part.column("text"))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))})

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return shared.map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, *, ranks: str, pattern: str) -> DataFrame:
    """rows of `encode` with decoded (binary) for ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks, pattern)
        for batch in batches:
            ids = batch.column("ids")
            data, at = bpe.decode(ids.flatten().to_numpy())
            cuts = at[ids.offsets.to_numpy() - ids.offsets[0].as_py()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "decoded": pa.array([bytes(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    return shared.map_arrow(rows.select("doc_id", "ids"), run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, then decodes the ids it has made, in one pass over each block of texts."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks, pattern)
        for batch in batches:
            for part in shared.blocks_of(batch, "text", 2 << 20):
                ids, offsets = bpe.chunked(part.column("text"))
                data, at = bpe.decode(ids)
                coded = np.ascontiguousarray(ids.astype("<u4")).data.cast("B")
                places, cuts = offsets.tolist(), at[offsets].tolist()
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                        "ids_sha256": [hashlib.sha256(coded[4 * a : 4 * b]).hexdigest() for a, b in zip(places, places[1:], strict=False)],
                        "decoded_sha256": [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)],
                    }
                )
        shared.release_memory()

    rows = shared.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return shared.map_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
