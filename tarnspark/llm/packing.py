"""Pattern packing: length patterns fitted to the length histogram by non-negative least squares, the rest by best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .sstable import encode_documents, ids_crc32


def few_document_patterns(present: np.ndarray, bins: int) -> np.ndarray:
    """All ways to fill `bins` with one to three lengths (in bins) that are present; a row each, 0 for no document."""
    have = np.flatnonzero(present[: bins + 1])
    have = have[have > 0]
    ok = np.zeros(bins + 1, dtype=bool)
    ok[have] = True
    out = [[bins, 0, 0]] if ok[bins] else []
    for a in have:
        if 2 * a <= bins and ok[bins - a]:
            out.append([bins - a, a, 0])
        b = have[(have >= a) & (have <= (bins - a) // 2)]
        c = bins - a - b
        b, c = b[ok[c]], c[ok[c]]
        out.extend([z, y, a] for z, y in zip(c.tolist(), b.tolist(), strict=True))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by active sets (Lawson and Hanson), on the normal equations."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    least = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope)) if n else -1
        if best < 0 or slope[best] <= least:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            sub = a[:, at]
            solved = np.linalg.solve(sub.T @ sub + 1e-10 * np.eye(len(at)), sub.T @ b)
            if solved.min() > 0:
                x[:] = 0
                x[at] = solved
                break
            bad = solved <= 0
            step = float((x[at][bad] / np.maximum(x[at][bad] - solved[bad], 1e-300)).min())
            x[at] += step * (solved - x[at])
            active[at[(x[at] <= 1e-12) & bad]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], max_len: int, width: int = 16, short: float = 0.125, short_weight: float = 0.1) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): how many sequences hold documents of these lengths. All documents of the histogram are placed.

    1. Patterns of one to three documents that fill a sequence are enumerated over lengths in bins of `width`, rounded up.
    2. Repeat counts are fitted to the binned histogram by non-negative least squares; lengths below `short` of a
       sequence weigh `short_weight`, as best fit places them anywhere.
    3. Counts are rounded down to what there is, and filled with true lengths, the longest of each bin first.
    4. What is left goes, longest first, where it fits best, into room left by patterns or into new sequences.

    Work and size depend on max_len, not on how many documents there are.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    bins = max_len // width
    counts = np.zeros(bins + 1)
    inside: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        b = -(-n // width)
        if b <= bins:
            counts[b] += left[n]
            inside[b].append(n)
    groups: list[tuple[tuple[int, ...], int]] = []
    patterns = few_document_patterns(counts > 0, bins)
    if len(patterns):
        a = np.zeros((bins + 1, len(patterns)))
        for k in range(3):
            used = patterns[:, k] > 0
            np.add.at(a, (patterns[used, k], np.flatnonzero(used)), 1.0)
        weight = np.where(np.arange(bins + 1) < short * bins, short_weight, 1.0)
        repeats = np.floor(nnls(a * weight[:, None], counts * weight) + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            wanted = int(repeats[k])
            while wanted > 0:
                taken, need = [], defaultdict(int)
                for b in patterns[k][patterns[k] > 0].tolist():
                    n = next((n for n in reversed(inside[b]) if left[n] > need[n]), None)
                    if n is None:
                        break
                    taken.append(n)
                    need[n] += 1
                else:
                    m = min(wanted, *(left[n] // c for n, c in need.items()))
                    groups.append((tuple(taken), m))
                    wanted -= m
                    for n, c in need.items():
                        left[n] -= m * c
                        if not left[n]:
                            inside[-(-n // width)].remove(n)
                    continue
                break
    return _best_fit({n: c for n, c in left.items() if c > 0}, groups, max_len)


def _best_fit(left: dict[int, int], groups: list[tuple[tuple[int, ...], int]], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    order: list[int] = []

    def put(lengths: tuple[int, ...], repeats: int) -> None:
        room = max_len - sum(lengths)
        if not rooms[room]:
            insort(order, room)
        rooms[room].append((lengths, repeats))

    for g in groups:
        put(*g)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            k = bisect_left(order, n)
            if k < len(order):
                room = order[k]
                lengths, repeats = rooms[room].pop()
                if not rooms[room]:
                    del order[k]
                m = min(c, repeats)
                if repeats > m:
                    put(lengths, repeats - m)
                put((*lengths, n), m)
                c -= m
            else:
                each = max_len // n
                if c >= each:
                    put((n,) * each, c // each)
                if c % each:
                    put((n,) * (c % each), 1)
                c = 0
    return [g for room in order for g in rooms[room]]


def _slots(groups: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For the documents of each length, by rank: sorted keys length << 40 | first rank, then sequence of that rank and offset."""
    ranks: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for lengths, repeats in groups:
        at = 0
        for n in lengths:
            rows.append((n << 40 | ranks[n], base, at))
            ranks[n] += repeats
            at += n
        base += repeats
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), base


def pack(docs: DataFrame, *, tokenizer: str, end_id: int, max_len: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = True, as_bytes: bool = False, vocabulary: int = 1 << 16) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids unless with_ids is false.

    Ids are dealt as bytes, two an id if `vocabulary` allows, four otherwise; as_bytes leaves them so.

    A document's ids and end_id form one piece, or several of max_len (the last may be shorter) if there are more.
    Tokens are made once, into a written table. The histogram of piece lengths (max_len numbers at most) goes to the
    driver, which plans the sequences (`plan`). A piece's rank among those of its length, counted by input partition and
    added up by a window over partitions, then says its place; so a length that a third of all pieces have is no hot key.

    Null texts count as empty: the end id alone. Null and repeated keys are rows like others. No rows: no rows.
    """
    spark = docs.sparkSession
    kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part_id = np.zeros(max_len + 1, dtype=np.int64), TaskContext.get().partitionId()
        for part, ids, offsets in encode_documents(batches, tokenizer, end_id):
            total = np.diff(offsets)
            pieces = -(-total // max_len)
            row = np.repeat(np.arange(len(total)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * max_len
            length = np.minimum(max_len, total[row] - start)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(row), dtype=np.int64)
            rank[order] = np.arange(len(row)) - np.searchsorted(ordered, ordered) + seen[ordered]
            np.add.at(seen, length, 1)
            cuts = np.append(offsets[row] + start, offsets[-1])
            out = {
                "doc_id": part.column("doc_id").take(pa.array(row)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "part": pa.array(np.full(len(row), part_id), pa.int32()),
                "rank": pa.array(rank, pa.int64()),
            }
            if not with_ids:
                out["ids_crc32"] = pa.array(ids_crc32(ids, cuts), pa.int64())
            else:
                if ids.max(initial=0) >= vocabulary:
                    raise ValueError(f"id {ids.max()} is beyond the vocabulary of {vocabulary}")
                out["ids"] = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((cuts * kind.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kind))])
            yield pa.record_batch(out)

    made = "ids binary" if with_ids else "ids_crc32 long"
    own = (", ids binary" if as_bytes else ", ids array<int>") if with_ids else ""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = shared.written(shared.map_arrow(rows, cut, f"doc_id long, piece int, start long, length long, part int, rank long, {made}"), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    groups = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, max_len)
    keys, bases, offsets, _ = _slots(groups)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = pieces.join(ranked, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 40 | rank, side="right") - 1
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("rank", "ids")}
            if with_ids:
                length = batch.column("length").to_numpy()
                cuts = np.append(0, np.cumsum(length))
                ids = _decoded(batch.column("ids"), int(cuts[-1]))
                columns["ids_crc32"] = pa.array(ids_crc32(ids, cuts), pa.int64())
                columns["ids"] = batch.column("ids") if as_bytes else pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
            columns["sequence_id"] = pa.array(bases[at] + rank - (keys[at] & (1 << 40) - 1), pa.int64())
            columns["offset"] = pa.array(offsets[at], pa.int64())
            yield pa.record_batch(columns)

    picked = placed.select("doc_id", "piece", "start", "length", "ids" if with_ids else "ids_crc32", "rank")
    return shared.map_arrow(picked, place, f"doc_id long, piece int, start long, length long, ids_crc32 long{own}, sequence_id long, offset long")


def _decoded(column: pa.Array, n: int) -> np.ndarray:
    """The n ids of all values of a binary column in a row."""
    data = pa.concat_arrays([column]).cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, dtype=np.uint8)
    return raw.view(np.dtype(f"<u{len(raw) // n}") if n else np.uint8)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence of `pack(..., with_ids=True)`: sequence_id, input_ids, doc_ids, lengths, pieces and starts (of its pieces, in order).

    input_ids are an array, or bytes if the pieces' are.
    """
    fields = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    rows = packed.select("sequence_id", fields.alias("p")).repartition("sequence_id").groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    as_bytes = dict(packed.dtypes)["ids"] == "binary"
    joined = F.aggregate("p", F.lit(b""), lambda all_ids, x: F.concat(all_ids, x.ids)) if as_bytes else F.flatten(F.transform("p", lambda x: x.ids))
    return rows.select(
        "sequence_id",
        joined.alias("input_ids"),
        F.transform("p", lambda x: x.doc_id).alias("doc_ids"),
        F.transform("p", lambda x: x.length.cast("int")).alias("lengths"),
        F.transform("p", lambda x: x.piece).alias("pieces"),
        F.transform("p", lambda x: x.start).alias("starts"),
    )


def unpacked(whole: DataFrame, with_ids: bool = False) -> DataFrame:
    """The pieces of `sequences`, read back from input_ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""

    as_bytes = dict(whole.dtypes)["input_ids"] == "binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("lengths")
            count, length = lengths.value_lengths().to_numpy(), lengths.flatten().to_numpy().astype(np.int64)
            cuts = np.append(0, np.cumsum(length))
            ids = _decoded(batch.column("input_ids"), int(cuts[-1])) if as_bytes else batch.column("input_ids").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), count)
            first = cuts[np.append(0, np.cumsum(count))]
            out = {
                "doc_id": batch.column("doc_ids").flatten(),
                "piece": batch.column("pieces").flatten(),
                "start": batch.column("starts").flatten(),
                "length": pa.array(length),
                "ids_crc32": pa.array(ids_crc32(ids, cuts), pa.int64()),
                "sequence_id": batch.column("sequence_id").take(pa.array(row)),
                "offset": pa.array(cuts[:-1] - first[row]),
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.record_batch(out)

    own = ", ids array<int>" if with_ids else ""
    return shared.map_arrow(whole, cut, f"doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long{own}")


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(shared.table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1, as_bytes=True)
    return unpacked(sequences(packed))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences with their ids, which follow one another by sequence_id and offset.

    Every document is packed: a null or empty text as the end id alone, a very long one in pieces; rows with a null doc_id
    and repeated rows are rows like others. Columns of docs but doc_id and text don't go further. No rows: no rows.
    """
    packed = pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1, as_bytes=True)
    return unpacked(sequences(packed), with_ids=True)
