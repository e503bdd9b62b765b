"""Structured Streaming over the event bus: idempotent ingest, windowed counts, a sticky drawdown breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "id string, ts timestamp, type string, severity string, title string, meta string"
TYPES = ("signup", "login", "click", "view", "purchase", "error")
SEVERITIES = ("info", "warning", "critical")


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One row per id among those that come within ``late`` of each other; unknown types and severities are flagged and kept."""
    known = F.col("type").isin(*TYPES) & F.col("severity").isin(*SEVERITIES)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"]).withColumn("known", known)


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tumbling counts by type and severity; rows beyond the watermark are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "type", "severity").count()
    return rows.select(F.col("window.start").alias("hour"), "type", "severity", F.col("count").alias("n"))


def critical(events: DataFrame) -> DataFrame:
    return events.where("severity = 'critical'")


BREAKER = "account string, seq long, netliq double, drawdown double, level int"


def _graded(rows: list[tuple[int, float]], peak: float, held: int) -> tuple[list[tuple[int, float, float, int]], float, int]:
    """(seq, netliq, drawdown, level) of rows in order, and the peak and the level after them; level 3 stays."""
    out = []
    for seq, value in rows:
        peak = max(peak, value)
        down = 1 - value / peak
        level = 3 if held == 3 or down > 0.08 else 2 if down > 0.06 else 1 if down > 0.04 else 0
        held = 3 if level == 3 else 0
        out.append((int(seq), float(value), down, level))
    return out, peak, held


def breaker(equity: DataFrame) -> DataFrame:
    """(account, seq, netliq), each account's rows in order across batches -> drawdown and level, carrying the peak and the level."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        out, *after = _graded(list(zip(rows["seq"], rows["netliq"])), *(state.get if state.exists else (float("-inf"), 0)))
        state.update(tuple(after))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["account", "seq", "netliq", "drawdown", "level"])

    return equity.groupBy("account").applyInPandasWithState(step, BREAKER, "peak double, held int", "append", GroupStateTimeout.NoTimeout)


def breaker_in_order(equity: DataFrame, late: str = "1 hour") -> DataFrame:
    """(account, ts, seq, netliq) in any order within ``late`` of event time -> drawdown and level as of the ordered rows.

    A row waits in its account's state until the watermark has passed it, then goes through in order of (ts, seq); an event-time timer wakes an account
    whose rows fall due without new ones. So the state holds the peak, the level and the rows of the last ``late``; rows that come later than
    that are dropped, as with every watermark.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        peak, held, *waiting = state.get if state.exists else (float("-inf"), 0, [], [], [])
        rows = list(zip(*waiting))
        if not state.hasTimedOut:
            for g in frames:
                rows += zip((g["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist(), g["seq"].tolist(), g["netliq"].tolist())
        rows.sort()
        mark = state.getCurrentWatermarkMs()
        due = [r for r in rows if r[0] < mark]
        rows = rows[len(due) :]
        out, peak, held = _graded([r[1:] for r in due], peak, held)
        state.update((peak, held, *([r[k] for r in rows] for k in range(3))))
        if rows:
            state.setTimeoutTimestamp(max(rows[0][0] + 1, mark + 1))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["account", "seq", "netliq", "drawdown", "level"])

    kept = "peak double, held int, times array<long>, seqs array<long>, values array<double>"
    return equity.withWatermark("ts", late).groupBy("account").applyInPandasWithState(step, BREAKER, kept, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, spark: SparkSession, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes what is there and returns the sink's rows."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.parquet(sink)
