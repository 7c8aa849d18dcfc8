"""Structured Streaming forms of the mergeable aggregates: the same columns as in batch, with watermarks and state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnspark.functions.shipping import ship


def _watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late) if events.isStreaming else rows


def windowed_moments(events: DataFrame, ts: str, value: str, *, by: Sequence[str] = (), width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, by, n, sum, sum2 of each time window: sufficient statistics, which merge by adding. Works on streams and tables."""
    rows = _watermarked(events, ts, late)
    v = F.col(value).cast("double")
    out = rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum2"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "sum", "sum2")


def windowed_counts(events: DataFrame, ts: str, level: str, *, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, level, n: a frequency table for each time window."""
    rows = _watermarked(events, ts, late)
    out = rows.groupBy(F.window(ts, width).alias("w"), level).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), level, "n")


def sessions(events: DataFrame, ts: str, by: Sequence[str], *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """by, start, end, n of each session: events of a key no more than gap apart."""
    rows = _watermarked(events, ts, late)
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def transitions(events: DataFrame, key: str, ts: str, state: str, tie: str | None = None) -> DataFrame:
    """key, previous, next, n: moves between states in each micro-batch of a stream; each key's last state is kept.

    Within a micro-batch a key's events go by ts, then tie; what arrives in a later one follows. Chunks of a sequence so
    stitch together as if they were one. Sum n by (previous, next) over the output for the whole. Null states are left out.
    """
    ship(events.sparkSession)
    kinds = dict(events.dtypes)

    def step(who, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["_ts", "_tie"], kind="stable")
        before = held.get[0] if held.exists else None
        moves: dict[tuple, int] = {}
        for now in rows["_state"]:
            if before is not None:
                moves[before, now] = moves.get((before, now), 0) + 1
            before = now
        held.update((before,))
        if moves:
            yield pd.DataFrame([(who[0], a, b, n) for (a, b), n in moves.items()], columns=[key, "previous", "next", "n"])

    rows = events.select(key, F.col(ts).cast("timestamp").alias("_ts"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), F.col(state).cast("string").alias("_state")).filter(F.col("_state").isNotNull())
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, previous string, next string, n long", "last string", "append", GroupStateTimeout.NoTimeout)


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """A writer of all that is there now, then it ends; started again, it goes on where it stopped."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
