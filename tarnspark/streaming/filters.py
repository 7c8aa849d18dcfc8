"""Filters of streams: a state for each series, moved on by each of its rows, as in a batch over the whole series."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnspark.functions.shipping import ship
from tarnspark.operators.structural import Model

#: Needed by stateful processors with timers.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_COLUMNS = "t long, y double, predicted double, predicted_sd double, level double, level_sd double, kind string"


class Kalman:
    """The filter of a structural model, row by row: state is (steps so far, mean, variance)."""

    def __init__(self, model: Model):
        if model.structure.summed or model.structure.predictors:
            raise ValueError("streams are filtered by models without predictors and sums")
        self.model, s = model, model.structure
        self.f, g = s.transition(), s.loads()
        self.q = (g * np.array([model.variances[c] for c in s.walking])) @ g.T
        self.h, self.r = s.signal(np.zeros(0)), model.variances["noise"]

    def start(self, who: str) -> list[np.ndarray]:
        return list(self.model.prior())

    def move(self, state: list[np.ndarray], who: str, t: int) -> list[np.ndarray]:
        m, p = state
        return [self.f @ m, self.f @ p @ self.f.T + self.q]

    def predict(self, state: list[np.ndarray]) -> tuple[float, float]:
        m, p = state
        return float(self.h @ m), float(np.sqrt(self.h @ p @ self.h + self.r))

    def see(self, state: list[np.ndarray], y: float, who: str, t: int) -> list[np.ndarray]:
        m, p = state
        ph = p @ self.h
        s = self.h @ ph + self.r
        p = p - np.outer(ph, ph) / s
        return [m + ph * (y - self.h @ m) / s, (p + p.T) / 2]

    def level(self, state: list[np.ndarray]) -> tuple[float, float]:
        return float(state[0][0]), float(np.sqrt(max(0.0, state[1][0, 0])))

    @property
    def sizes(self) -> list[tuple[int, ...]]:
        d = self.model.structure.dim
        return [(d,), (d, d)]


class Particles:
    """A walking level whose variances are unknown as well: particles of (level, log variance of its steps, log variance of
    the noise), weighed by each row and drawn anew, with the variances' logarithms shrunk to their mean and spread as much as
    that takes away (Liu and West). Draws depend on the seed, the series and the step alone, so they are the same however rows
    come in."""

    def __init__(self, mean: float, sd: float, variances: tuple[float, float], spread: float = 1.0, n: int = 1000, discount: float = 0.98, seed: int = 0):
        self.mean, self.sd, self.middle, self.spread, self.n, self.seed = mean, sd, np.log(variances), spread, n, seed
        self.shrink = (3 * discount - 1) / (2 * discount)

    def _draws(self, who: str, t: int, what: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, int.from_bytes(hashlib.sha256(who.encode()).digest()[:8], "little"), t & (1 << 64) - 1, what])

    def start(self, who: str) -> list[np.ndarray]:
        draw = self._draws(who, 0, 0)
        return [np.stack([self.mean + self.sd * draw.standard_normal(self.n), *(self.middle[:, None] + self.spread * draw.standard_normal((2, self.n)))])]

    def move(self, state: list[np.ndarray], who: str, t: int) -> list[np.ndarray]:
        (x,) = state
        return [np.stack([x[0] + np.exp(x[1] / 2) * self._draws(who, t, 1).standard_normal(self.n), x[1], x[2]])]

    def predict(self, state: list[np.ndarray]) -> tuple[float, float]:
        (x,) = state
        return float(x[0].mean()), float(np.sqrt(x[0].var() + np.exp(x[2]).mean()))

    def see(self, state: list[np.ndarray], y: float, who: str, t: int) -> list[np.ndarray]:
        (x,) = state
        fit = -0.5 * (x[2] + (y - x[0]) ** 2 * np.exp(-x[2]))
        weight = np.exp(fit - fit.max())
        draw = self._draws(who, t, 2)
        at = np.minimum(np.searchsorted(np.cumsum(weight), (np.arange(self.n) + draw.random()) / self.n * weight.sum(), side="right"), self.n - 1)
        x = x[:, at]
        logs, a = x[1:], self.shrink
        middle, spread = logs.mean(axis=1, keepdims=True), np.atleast_2d(np.cov(logs))
        root = np.linalg.cholesky(spread * (1 - a * a) + 1e-12 * np.eye(2))
        return [np.concatenate([x[:1], a * logs + (1 - a) * middle + root @ draw.standard_normal((2, self.n))])]

    def level(self, state: list[np.ndarray]) -> tuple[float, float]:
        return float(state[0][0].mean()), float(state[0][0].std())

    @property
    def sizes(self) -> list[tuple[int, ...]]:
        return [(3, self.n)]


def _steps(filter_, state: list[np.ndarray] | None, last: int | None, who: str, rows: pd.DataFrame) -> tuple[list[np.ndarray], int, list[tuple]]:
    """A series' rows in order of time -> state, last step, and what is said of each row.

    Steps without a row only move the state on. A row of a step gone by is late: it says nothing, and is not lost."""
    out = []
    state = filter_.start(who) if state is None else state
    for t, y in zip(rows["row_time"].tolist(), rows["row_value"].tolist(), strict=True):
        if last is not None and t <= last:
            out.append((t, None if y is None or y != y else y, None, None, None, None, "late"))
            continue
        for step in range(t if last is None else last + 1, t + 1):
            state = filter_.move(state, who, step)
        last = t
        predicted = filter_.predict(state)
        seen = y is not None and y == y
        if seen:
            state = filter_.see(state, y, who, t)
        out.append((t, y if seen else None, *predicted, *filter_.level(state), "row" if seen else "missing"))
    return state, last, out


def _framed(key: Sequence, by: Sequence[str], out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*key, *r) for r in out], columns=[*by, "t", "y", "predicted", "predicted_sd", "level", "level_sd", "kind"])


def _columns(df: DataFrame, y: str, time: str, by: Sequence[str], extra: Sequence = ()) -> DataFrame:
    # Spark renames columns that begin with _ on their way to a processor
    return df.select(*by, F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("row_series"), F.col(time).cast("bigint").alias("row_time"), F.col(y).cast("double").alias("row_value"), *extra).filter(F.col("row_time").isNotNull())


def _schema(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by) + _COLUMNS


def filtered(df: DataFrame, filter_, y: str, time: str, by: Sequence[str]) -> DataFrame:
    """by, t, y, predicted, predicted_sd (before the row), level, level_sd (after it), kind: what the filter says of each row of a
    table. A series is one group here (`structural` cuts long ones); steps of no row move the state on. kind: row, missing (no
    y), or late (a second row of a step)."""
    ship(df.sparkSession)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row_time", "row_value"])
        return _framed(key, by, _steps(filter_, None, None, rows["row_series"].iloc[0], rows)[2])

    return _columns(df, y, time, by).groupBy(*by).applyInPandas(run, _schema(df, by))


class _Processor(StatefulProcessor):
    def __init__(self, filter_, by: Sequence[str], idle_ms: int | None):
        self.filter, self.by, self.idle_ms = filter_, list(by), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("filter", "who string, last long, numbers array<double>")

    def _read(self) -> tuple[list[np.ndarray] | None, int | None, str | None]:
        if not self.state.exists():
            return None, None, None
        who, last, numbers = self.state.get()
        flat, out = np.asarray(numbers, dtype=float), []
        for size in self.filter.sizes:
            n = int(np.prod(size))
            out.append(flat[:n].reshape(size))
            flat = flat[n:]
        return out, last, who

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["row_time", "row_value"])
        state, last, _ = self._read()
        who = frame["row_series"].iloc[0]
        state, last, out = _steps(self.filter, state, last, who, frame)
        self.state.update((who, int(last), np.concatenate([np.ravel(x) for x in state]).tolist()))
        if self.idle_ms is not None:
            timers = list(self.handle.listTimers())
            due = max([int(frame["row_ms"].max()) + self.idle_ms, *timers])
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        yield _framed(key, self.by, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, last, _ = self._read()
        if state is not None:
            self.state.clear()
            yield _framed(key, self.by, [(last, None, None, None, *self.filter.level(state), "idle")])

    def close(self) -> None:
        pass


def filtered_stream(stream: DataFrame, filter_, y: str, time: str, by: Sequence[str], *, ts: str | None = None, late: str = "1 hour", idle: int | None = None) -> DataFrame:
    """The columns of `filtered`, of a stream: each series' state is kept between micro-batches, so rows are said to be the same
    as in one batch, if they come in order of time. Within a micro-batch they are put in order; what comes after a later step
    was seen is `late`.

    ts, idle: with an event time and so many seconds, a series' state goes once the watermark (`late` behind the newest event)
    has passed by so much since its last row, and a last row of kind idle says where it stood; rows behind the watermark are
    left out, as everywhere in Spark. Null times are left out.
    """
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set(*_STORE)
    timed = ts is not None and idle is not None
    rows = _columns(stream, y, time, by, [F.col(ts).cast("timestamp").alias("row_event"), F.unix_millis(F.col(ts).cast("timestamp")).alias("row_ms")] if timed else [])
    rows = rows.withWatermark("row_event", late) if timed else rows
    return rows.groupBy(*by).transformWithStateInPandas(_Processor(filter_, by, 1000 * idle if timed else None), _schema(stream, by), "Append", "EventTime" if timed else "None")
