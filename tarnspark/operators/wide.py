"""Regressions on thousands of predictors that stand in one array column: Gramians in tiles, screening block by block.

No expression, and no array on the driver, grows with the square of the number of predictors: products are taken in numpy on
Arrow batches, tile by tile, and a task holds as many tiles at a time as it is told to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.functions.shipping import ship

from .models import inclusion_draws
from .moments import Moments

#: Columns of a tile, and cells of all tiles that a task adds up at a time (32 MB).
BLOCK, CELLS = 500, 1 << 22
#: Rows of a tile that go on together.
_TOGETHER = 256


def _rows(df: DataFrame, vector: str, y: Column | None) -> DataFrame:
    return df.select(F.col(vector).cast("array<double>").alias("v"), *([] if y is None else [y.cast("double").alias("y")]))


def _matrix(batch: pa.RecordBatch, dim: int, with_y: bool) -> np.ndarray:
    """The whole vectors of a batch as rows, y (if asked for) as the last column; rows that miss any of it are left out."""
    v = batch.column("v")
    whole = pc.fill_null(pc.equal(pc.list_value_length(v), dim), False)
    x = v.filter(whole).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    if with_y:
        x = np.column_stack([x, batch.column("y").filter(whole).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)])
    return x[~np.isnan(x).any(axis=1)]


def centre(df: DataFrame, vector: str, dim: int, y: Column | None = None) -> tuple[int, np.ndarray]:
    """Rows, and the mean of each component (then of y), over rows that miss none: one row of `dim` numbers comes to the driver."""
    ship(df.sparkSession)
    with_y, k = y is not None, dim + (y is not None)
    kind = "n long, mean array<double>"

    def row(n: int, mean: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"n": pa.array([n], pa.int64()), "mean": pa.array([mean.tolist()], pa.list_(pa.float64()))})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean = 0, np.zeros(k)
        for batch in batches:
            x = _matrix(batch, dim, with_y)
            if len(x):
                n += len(x)
                mean += (x - mean).sum(axis=0) / n
        yield row(n, mean)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean = 0, np.zeros(k)
        for batch in batches:
            for more, own in zip(batch.column("n").to_pylist(), batch.column("mean").to_pylist(), strict=True):
                if more:
                    n += more
                    mean += (np.array(own) - mean) * (more / n)
        yield row(n, mean)

    found = _rows(df, vector, y).mapInArrow(part, kind).repartition(1).mapInArrow(merge, kind).first()
    return found.n, np.array(found.mean)


def _edges(dim: int, block: int, with_y: bool) -> list[int]:
    return [*range(0, dim, block), dim, *([dim + 1] if with_y else [])]


def gramian_tiles(df: DataFrame, vector: str, dim: int, *, block: int = BLOCK, y: Column | None = None, tiles: Sequence[tuple[int, int]] | None = None, middle: np.ndarray | None = None, cells: int = CELLS) -> DataFrame:
    """tile_i, tile_j, i, values: rows of tiles of the centred products of vectors of `dim` numbers.

    Tile (a, b) holds the products of the columns block * a, block * a + 1 ... with those from block * b on; `i` is the first
    one's number and `values` are its products with each of the others. y, if given, is a column after all others, in a block
    of its own. tiles: those wanted, else all with tile_i <= tile_j. middle: what to centre on, else the means (one pass more).

    A task adds up tiles of `cells` numbers at most, so wide vectors are read several times, once for each share of the tiles.
    Each task's sums meet by tile and are added as they come. Vectors of another length, or that miss a value, are left out.
    """
    ship(df.sparkSession)
    with_y = y is not None
    if middle is None:
        middle = centre(df, vector, dim, y)[1]
    edges = _edges(dim, block, with_y)
    spans = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    wanted = [(a, b) for a in range(len(spans)) for b in range(a, len(spans))] if tiles is None else list(tiles)
    size = lambda t: (spans[t[0]].stop - spans[t[0]].start) * (spans[t[1]].stop - spans[t[1]].start)
    shares: list[list[tuple[int, int]]] = [[]]
    for t in wanted:
        if shares[-1] and sum(map(size, shares[-1])) + size(t) > cells:
            shares.append([])
        shares[-1].append(t)
    at = df.sparkSession.sparkContext.broadcast(middle)
    kind = "tile_i int, tile_j int, i int, values array<double>"

    def emitted(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (a, b), m in sums.items():
            for low in range(0, len(m), _TOGETHER):
                part = m[low : low + _TOGETHER]
                ends = np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)
                yield pa.record_batch({"tile_i": pa.array(np.full(len(part), a), pa.int32()), "tile_j": pa.array(np.full(len(part), b), pa.int32()), "i": pa.array(spans[a].start + low + np.arange(len(part)), pa.int32()), "values": pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))})

    def products(share: list[tuple[int, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {(a, b): np.zeros((spans[a].stop - spans[a].start, spans[b].stop - spans[b].start)) for a, b in share}
            some = False
            for batch in batches:
                x = _matrix(batch, dim, with_y) - at.value
                some |= len(x) > 0
                for (a, b), m in sums.items():
                    m += x[:, spans[a]].T @ x[:, spans[b]]
            if some:
                yield from emitted(sums)

        return run

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            values, starts = batch.column("values").flatten().to_numpy(), batch.column("values").offsets.to_numpy()
            for k, (a, b, i) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("tile_i", "tile_j", "i")], strict=True)):
                if (a, b) not in sums:
                    sums[a, b] = np.zeros((spans[a].stop - spans[a].start, spans[b].stop - spans[b].start))
                sums[a, b][i - spans[a].start] += values[starts[k] - starts[0] : starts[k + 1] - starts[0]]
        yield from emitted(sums)

    rows = _rows(df, vector, y)
    out = rows.mapInArrow(products(shares[0]), kind)
    for share in shares[1:]:
        out = out.unionByName(rows.mapInArrow(products(share), kind))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(4 * sum(map(size, wanted)) / cells))
    return out.repartition(parts, "tile_i", "tile_j").mapInArrow(add, kind)


def screen(df: DataFrame, y: Column, vector: str, dim: int, *, block: int = BLOCK, draws: int = 100, burn: int = 20, expected_size: float = 1.0, seed: int = 0, cells: int = CELLS) -> DataFrame:
    """predictor, inclusion: the share of draws that hold a predictor, in a spike-and-slab regression on its block alone.

    Only the tiles on the diagonal and those with y are added up, so this grows with predictors times `block`. Blocks are drawn
    from in parallel, each by its own stream of numbers (seed and block)."""
    n, middle = centre(df, vector, dim, y)
    if not n:
        raise ValueError("no row has a whole vector and a response")
    blocks = len(_edges(dim, block, False)) - 1
    wanted = [(blocks, blocks), *[t for a in range(blocks) for t in ((a, a), (a, blocks))]]
    tiles = gramian_tiles(df, vector, dim, block=block, y=y, tiles=wanted, middle=middle, cells=cells).persist()
    try:
        yty = float(tiles.filter(F.col("tile_i") == blocks).first()["values"][0])

        def sample(rows: pd.DataFrame) -> pd.DataFrame:
            own, pull = (rows[same].sort_values("i") for same in (rows.tile_j != blocks, rows.tile_j == blocks))
            a = int(rows.tile_i.iloc[0])
            inside = np.zeros(len(own))
            for at, _, _ in inclusion_draws(np.stack(own["values"].to_list()), np.concatenate(pull["values"].to_list()), yty, n, draws=draws, burn=burn, expected_size=expected_size, rng=np.random.default_rng((seed, a))):
                inside[at] += 1
            return pd.DataFrame({"predictor": own.i.to_numpy(), "inclusion": inside / draws})

        # as many rows as predictors: they are kept, so that the tiles can go
        found = tiles.filter(F.col("tile_i") < blocks).groupBy("tile_i").applyInPandas(sample, "predictor int, inclusion double").toPandas()
    finally:
        tiles.unpersist()
    return df.sparkSession.createDataFrame(found, "predictor int, inclusion double")


def chosen_moments(df: DataFrame, y: Column, vector: str, dim: int, at: Sequence[int]) -> Moments:
    """Moments of these components, then of y, over rows with a whole vector and a response."""
    ship(df.sparkSession)
    columns = [*at, dim]
    kind = "n long, w double, mean array<double>, low array<double>, s array<double>"
    kinds = pa.schema([("n", pa.int64()), ("w", pa.float64()), *[(c, pa.list_(pa.float64())) for c in ("mean", "low", "s")]])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Moments.none(len(columns))
        for batch in batches:
            x = _matrix(batch, dim, True)
            if len(x):
                out += Moments.of(np.ascontiguousarray(x[:, columns]))
        yield pa.RecordBatch.from_pydict(out.lists(), kinds)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Moments.none(len(columns))
        for batch in batches:
            for held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out += Moments.read(*held)
        yield pa.RecordBatch.from_pydict(out.lists(), kinds)

    return Moments.read(*_rows(df, vector, y).mapInArrow(part, kind).repartition(1).mapInArrow(merge, kind).first())


def wide_spike_and_slab(df: DataFrame, y: Column, vector: str, dim: int, *, block: int = BLOCK, keep: float = 0.1, screening: int = 100, draws: int = 500, burn: int = 100, expected_size: float = 5.0, seed: int = 0, cells: int = CELLS) -> DataFrame:
    """predictor, inclusion, mean, sd (of the coefficient over all draws) of the predictors that pass the screen, in posterior
    draws of one spike-and-slab regression on all of them.

    1. `screen`: each block alone. Predictors with an inclusion of `keep` or more stay. 2. One pass for the moments of those,
    whose number the priors hold near what the data tell apart, not near `dim`. 3. Draws on the driver, from moments alone.
    Predictors that were screened out have no row; no predictor passes: no rows.
    """
    passed = screen(df, y, vector, dim, block=block, draws=screening, seed=seed, cells=cells).filter(F.col("inclusion") >= keep)
    at = sorted(r.predictor for r in passed.select("predictor").collect())
    kind = "predictor int, inclusion double, mean double, sd double"
    if not at:
        return df.sparkSession.createDataFrame([], kind)
    m = chosen_moments(df, y, vector, dim, at)
    rng, k = np.random.default_rng((seed, 1 << 20)), len(at)
    inside, first, second = np.zeros(k), np.zeros(k), np.zeros(k)
    for here, b, _ in inclusion_draws(m.s[:k, :k], m.s[:k, k], float(m.s[k, k]), m.n, draws=draws, burn=burn, expected_size=expected_size, rng=rng, coefficients=True):
        inside[here] += 1
        first[here] += b
        second[here] += b * b
    mean = first / draws
    sd = np.sqrt(np.maximum(0.0, second / draws - mean**2))
    return df.sparkSession.createDataFrame([(int(p), float(i), float(a), float(s)) for p, i, a, s in zip(at, inside / draws, mean, sd, strict=True)], kind)
