"""Toxicity by non-negative positive-unlabelled learning: confirmed toxic texts and unlabelled ones train a linear classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import shared

#: Features of a model, at most, and features of confirmed rows that are counted in all rows.
MAX_FEATURES, MAX_CANDIDATES = 20_000, 200_000
#: Bytes of text that a worker goes through at once, and words whose features it remembers. A block takes some 40 times its bytes on
#: the way; a worker stands beside others and the JVM.
BLOCK_BYTES, KEPT_WORDS = 1 << 19, 200_000
#: Distinct feature sets that are fitted on the driver; beyond that each step is a Spark job over all of them.
LOCAL_SETS = 300_000


@dataclass
class Model:
    """Weights of the features (a word, or the beginning of a word and *), a bias, and the class prior it was fitted with."""

    weights: dict[str, float]
    bias: float
    prior: float


def word_features(word: bytes) -> list[str]:
    w = word.decode(errors="replace").lower()
    return [w, *(w[:k] + "*" for k in range(4, 9) if len(w) > k)]


#: Sums over rows at given weights: loss of calling unlabelled and positive rows negative, and its slopes by feature (bias last).
Sums = tuple[float, float, np.ndarray, np.ndarray]


def _sums(rows: np.ndarray, features: np.ndarray, n_features: int, positive: np.ndarray, share: np.ndarray, w: np.ndarray, b: float) -> Sums:
    g = np.bincount(rows, weights=w[features], minlength=len(positive)) + b
    low, p = np.logaddexp(0, g) * share, share / (1 + np.exp(-np.clip(g, -30, 30)))
    by_kind = []
    for kind in (~positive, positive):
        own = np.where(kind, p, 0.0)
        by_kind.append(np.append(np.bincount(features, weights=own[rows], minlength=n_features), own.sum()))
    return float(low[~positive].sum()), float(low[positive].sum()), *by_kind


def descend(sums, mean: np.ndarray, n_features: int, prior: float, *, steps: int = 600, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier with the logistic loss, by the non-negative risk of positive and unlabelled rows.

    sums: (weights, bias) to Sums over all rows, each kind's rows sharing 1; mean: the share of the positive rows that
    hold each feature, and 1. Risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); while the second part is below zero,
    its gradient is followed upwards instead. Whole-batch steps by Adam; always the same result.
    """
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        low_u, low_p, slope_u, slope_p = sums(w, b)
        rest = low_u - prior * low_p
        grad = (slope_u - prior * slope_p) * (1.0 if rest >= 0 else -1.0)
        if rest >= 0:
            grad = grad + prior * (slope_p - mean)  # of calling a positive row positive
        grad[:-1] += ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (1 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def fit_nnpu(x: tuple[np.ndarray, np.ndarray], n_features: int, positive: np.ndarray, prior: float, counts: np.ndarray | None = None, **how) -> tuple[np.ndarray, float]:
    """`descend` over rows in memory. x: row and feature of each entry that is 1; counts: how many rows each row stands for."""
    rows, features = x
    counts = np.ones(len(positive)) if counts is None else counts.astype(np.float64)
    share = counts / np.where(positive, max(1.0, counts[positive].sum()), max(1.0, counts[~positive].sum()))
    held = np.where(positive, share, 0.0)
    mean = np.append(np.bincount(features, weights=held[rows], minlength=n_features), held.sum())
    return descend(lambda w, b: _sums(rows, features, n_features, positive, share, w, b), mean, n_features, prior, **how)


def fit_nnpu_on_spark(sets: DataFrame, n_features: int, sizes: tuple[int, int], prior: float, **how) -> tuple[np.ndarray, float]:
    """The same over a table of any size (kind, features, n): each step is one job that sums over its partitions."""

    def sums(w: np.ndarray, b: float) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, slope = np.zeros(2), np.zeros((2, n_features + 1))
            for batch in batches:
                rows, features, positive, counts = _entries(batch)
                share = counts / np.where(positive, max(1, sizes[1]), max(1, sizes[0]))
                part = _sums(rows, features, n_features, positive, share, w, b)
                low += part[:2]
                slope += part[2:]
            at = np.flatnonzero(slope.any(axis=0))
            yield pa.record_batch({"feature": pa.array(np.append(at, -1), pa.int32()), "u": pa.array(np.append(slope[0, at], low[0])), "p": pa.array(np.append(slope[1, at], low[1]))})

        found = shared.map_arrow(sets, run, "feature int, u double, p double").groupBy("feature").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).toArrow()
        u, p = np.zeros(n_features + 2), np.zeros(n_features + 2)
        u[found["feature"].to_numpy()], p[found["feature"].to_numpy()] = found["u"].to_numpy(), found["p"].to_numpy()  # -1: the losses
        return u[-1], p[-1], u[:-1], p[:-1]

    held = sets.filter("kind = 1").select(F.explode("features").alias("f"), "n").groupBy("f").agg(F.sum("n").alias("n")).collect()
    mean = np.zeros(n_features + 1)
    for r in held:
        mean[r.f] = r.n / max(1, sizes[1])
    mean[-1] = 1.0 if sizes[1] else 0.0
    return descend(sums, mean, n_features, prior, **how)


def _entries(sets: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and feature of each entry, whether each row is positive, and how many rows it stands for."""
    lists = sets.column("features")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    rows = np.repeat(np.arange(sets.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    return rows, lists.flatten().to_numpy().astype(np.int64), sets.column("kind").to_numpy() == 1, sets.column("n").to_numpy().astype(np.float64)


@lru_cache(maxsize=1)
def _encoder(names: tuple[str, ...]) -> shared.ChunkEncoder:
    """The numbers of the features of each word; one for each worker process."""
    number = {f: k for k, f in enumerate(names)}

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = [[number[f] for f in word_features(w) if f in number] for w in words]
        return np.fromiter(map(len, each), dtype=np.int32, count=len(each)), np.fromiter(chain.from_iterable(each), dtype=np.uint32)

    return shared.by_word(encode, KEPT_WORDS)


def _held(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of all distinct pairs, sorted."""
    ids, offsets = _encoder(names)(column)
    pairs = np.unique(np.repeat(np.arange(len(column)), np.diff(offsets)) * max(1, len(names)) + ids)
    return pairs // max(1, len(names)), pairs % max(1, len(names))


def _all_features(texts: DataFrame) -> DataFrame:
    """feature, n: in how many rows of texts (text) each stands; for the confirmed rows, which are few beside all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in shared.blocks_of(batch, "text", BLOCK_BYTES):
                words = shared.Words(part.column("text"), plain=True)
                each = [word_features(w) for w in words.distinct]
                of_row: list[set] = [set() for _ in range(part.num_rows)]
                for row, word in np.unique(np.stack([words.row, words.which], axis=1), axis=0).tolist() if len(words.which) else ():
                    of_row[row].update(each[word])
                for found in of_row:
                    total.update(found)
                if len(total) > 200_000:
                    yield pa.record_batch({"feature": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
                    total = Counter()
        yield pa.record_batch({"feature": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
        del total
        shared.release_memory()

    return shared.map_arrow(texts.select("text"), run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _feature_counts(texts: DataFrame, names: tuple[str, ...]) -> tuple[np.ndarray, int]:
    """In how many rows of texts each of the features stands, and how many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(names), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in shared.blocks_of(batch, "text", BLOCK_BYTES):
                total += np.bincount(_held(part.column("text"), names)[1], minlength=len(names))
        at = np.flatnonzero(total)
        yield pa.record_batch({"feature": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(total[at], n), pa.int64())})
        shared.release_memory()

    found = shared.map_arrow(texts.select("text"), run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(names) + 1, dtype=np.int64)
    out[found["feature"].to_numpy()] = found["n"].to_numpy()
    return out[:-1], int(out[-1])


def _feature_sets(texts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """features, n: the distinct sets of features among the rows of texts, and how many rows have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in shared.blocks_of(batch, "text", BLOCK_BYTES):
                row, feature = _held(part.column("text"), names)
                raw, cuts = feature.astype(np.int32).tobytes(), (4 * np.searchsorted(row, np.arange(part.num_rows + 1))).tolist()
                seen.update(raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
                if len(seen) > 20_000:
                    yield table(seen)
                    seen = Counter()
        yield table(seen)
        shared.release_memory()

    def table(seen: Counter) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(x) // 4 for x in seen)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(seen), dtype=np.int32)))
        return pa.record_batch({"features": lists, "n": pa.array(list(seen.values()), pa.int64())})

    return shared.map_arrow(texts.select("text"), run, "features array<int>, n long").groupBy("features").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_features: int = MAX_FEATURES,
    min_rows: int = 5,
    min_share: float = 0.0005,
    min_purity: float = 0.6,
    local_sets: int = LOCAL_SETS,
    **how,
) -> Model:
    """Fits a Model on all rows. docs: doc_id, text; labels: doc_id, toxic (1: confirmed). Unlabelled are all rows, whatever their label.

    Features are words and beginnings of words that stand in min_rows and min_share of the confirmed rows at least, and of
    whose rows min_purity are toxic, going by prior and by both frequencies, counted over all rows; the strongest
    max_features. Each row then is its set of features; rows of equal sets are fitted as one with their number. Up to
    local_sets sets are fitted on the driver, more in Spark jobs, step by step, with the same result but for rounding.

    The class prior is the share of confirmed rows among all labelled ones. A doc_id labelled twice counts as confirmed if
    one label is; null doc_ids are not learned from; of a repeated doc_id each row counts. Without confirmed rows the
    model says 0 to all.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    share = docs.select("doc_id").join(marks, "doc_id").agg(F.avg("toxic").alias("p")).first().p
    if not share:
        return Model({}, -30.0, 0.0)
    prior = min(max(share, 1e-4), 0.9)
    toxic = marks.filter("toxic = 1").select("doc_id")
    confirmed = shared.written(shared.maybe_in(docs, toxic, "doc_id").join(toxic, "doc_id").select("text"), "confirmed")
    n_positive = confirmed.count()
    often = _all_features(confirmed.repartition(shared.parts_for(docs.sparkSession, 0, 1))).filter(F.col("n") >= max(min_rows, min_share * n_positive))
    found = [(r.feature, r.n) for r in often.orderBy(F.desc("n"), "feature").limit(MAX_CANDIDATES).collect()]
    u, n_rest = _feature_counts(docs, tuple(f for f, _ in found))
    p = np.array([n for _, n in found], dtype=np.float64)
    purity = prior * (p / n_positive) / ((u + 1) / (n_rest + 1))
    strong = sorted((-p[k] * purity[k], found[k][0]) for k in np.flatnonzero(purity >= min_purity).tolist())[:max_features]
    names = tuple(f for _, f in strong)
    sets = _feature_sets(confirmed, names).select(F.lit(1).alias("kind"), "features", "n").unionByName(_feature_sets(docs, names).select(F.lit(0).alias("kind"), "features", "n"))
    sets = shared.written(sets, "feature-sets")
    if sets.count() <= local_sets:
        rows, features, positive, counts = _entries(sets.orderBy("kind", "features").toArrow())
        w, b = fit_nnpu((rows, features), len(names), positive, prior, counts, **how)
    else:
        w, b = fit_nnpu_on_spark(sets, len(names), (n_rest, n_positive), prior, **how)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-6}, b, prior)


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "toxicity", without: Sequence[str] = ()) -> DataFrame:
    """docs with `into` (0 to 1) for each whole text; a text without known words has the bias alone, as has a null one. No shuffle.

    A column of docs called `into`, in any case, is replaced; all others stay, but for those in `without`: naming the text
    there spares its way back from Python.
    """
    names = tuple(model.weights)
    weights, bias = np.fromiter(model.weights.values(), dtype=np.float64, count=len(names)), model.bias
    read = docs.drop(*[c for c in docs.columns if c.lower() == into.lower()])
    kept = [c for c in read.columns if c not in without]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.blocks_of(batch, text, BLOCK_BYTES):
                row, feature = _held(part.column(text), names)
                g = bias + np.bincount(row, weights=weights[feature], minlength=part.num_rows)
                yield part.select(kept).append_column(into, pa.array(1 / (1 + np.exp(-np.clip(g, -500, 500))), pa.float64()))
        shared.release_memory()

    schema = StructType([*read.select(kept).schema.fields, StructField(into, DoubleType())])
    return shared.map_arrow(read, run, schema)


def _held_out(docs: DataFrame):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return train(docs.filter(~_held_out(docs)).select("doc_id", "text"), shared.table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op8_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, _trained(spark, docs, sf_dir), without=["text"])
    return scored.select("doc_id", _held_out(docs).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.7, 1).otherwise(0).alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents scored below 0.7, by a model trained on the documents that are left.

    All columns stay as they are, whatever they are called. Null and empty texts score by the bias alone; very long ones are
    read whole; null doc_ids are scored but not learned from, repeated rows are rows like others. No rows: no rows.
    """
    into = shared.unused(docs, "toxicity")
    return score(docs, _trained(spark, docs, sf_dir), into=into).filter(F.col(into) < 0.7).drop(into)
