"""Column helpers over a panel: one row per symbol and date.

A rolling value is null until its frame holds ``n`` non-null rows, as a rolling window of that length has it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def by_symbol():
    return W.partitionBy("symbol").orderBy("date")


def by_date():
    return W.partitionBy("date")


def rolling(agg: Callable, x: str | Column, n: int, least: int | None = None, back: int = 0, by=None) -> Column:
    """``agg(x)`` over the ``n`` rows that end ``back`` rows ago, null with fewer than ``least`` (default ``n``) values."""
    frame = (by or by_symbol()).rowsBetween(-(n - 1) - back, -back)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg(x).over(frame))


def with_long_frames(rows: DataFrame, part: int, made: dict[str, tuple[str, str, int]]) -> DataFrame:
    """``rows`` with columns name -> (avg, max or min; column; frame), the frames whole multiples of ``part`` rows that end at the row.

    A frame that slides is added up anew for each row. Here each row adds up ``part`` rows, and a long frame is put together of those parts
    by lags in the same sort: part + n / part steps a row in place of n. An avg is null until its frame holds n values; the others take what is there.
    """
    frame, order = by_symbol().rowsBetween(1 - part, 0), by_symbol()
    pieces = {f"_{kind}_{x}": getattr(F, kind)(x).over(frame) for op, x, _ in made.values() for kind in (("sum", "count") if op == "avg" else (op,))}

    def whole(kind: str, x: str, n: int) -> list[Column]:
        return [F.col(f"_{kind}_{x}"), *(F.lag(f"_{kind}_{x}", at).over(order) for at in range(part, n, part))]

    def put(op: str, x: str, n: int) -> Column:
        if op != "avg":
            held = whole(op, x, n)
            return {"max": F.greatest, "min": F.least}[op](*held) if len(held) > 1 else held[0]
        known, total = (sum((F.coalesce(p, F.lit(0)) for p in whole(kind, x, n)[1:]), F.coalesce(F.col(f"_{kind}_{x}"), F.lit(0))) for kind in ("count", "sum"))
        return F.when(known >= n, total / n)

    return rows.withColumns(pieces).withColumns({name: put(*how) for name, how in made.items()}).drop(*pieces)


@dataclass(frozen=True)
class Frame:
    """What ``swept`` makes of ``x``: avg, max, min or std over the ``n`` rows that end ``back`` rows ago, null with fewer than ``least`` (default ``n``) values; or lag, ``x`` as it was ``back`` rows ago."""

    op: str
    x: str
    n: int = 1
    back: int = 0
    least: int | None = None

    def over(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For the last rows of ``x`` (nan: none), of which row i is the ``place[i]``-th of its symbol."""
        ago = np.arange(self.n - 1, -1, -1) + self.back
        x = np.concatenate([np.full(max(0, len(place) + ago[0] - len(x)), np.nan), x])
        at = len(x) - len(place) - ago[0]
        rows = np.lib.stride_tricks.sliding_window_view(x[at : len(x) - self.back], self.n)
        early = np.flatnonzero(place <= ago[0])  # the frame reaches beyond the symbol's first row
        if self.op == "lag":
            out = rows[:, 0].copy()
            out[early] = np.nan
            return out
        out, known = self._added(rows)
        if len(early):
            out[early], known[early] = self._added(np.where(ago < place[early, None], rows[early], np.nan))
        return np.where(known >= (self.n if self.least is None else self.least), out, np.nan)

    def _added(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have = ~np.isnan(rows)
        known = have.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.op in ("max", "min"):
                return (np.fmax if self.op == "max" else np.fmin).reduce(rows, axis=1), known
            values = rows if have.all() else np.where(have, rows, 0.0)
            mean = values.sum(axis=1) / known
            if self.op == "avg":
                return mean, known
            gaps = np.where(have, rows - mean[:, None], 0.0)
            return np.sqrt((gaps * gaps).sum(axis=1) / (known - 1)), known


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` with each symbol's whole history in one partition, by date, and ``n_bars``, a row's place in it: what ``swept`` needs."""
    return rows.repartition("symbol").sortWithinPartitions("symbol", "date").withColumn("n_bars", F.row_number().over(by_symbol()))


def swept(rows: DataFrame, *steps: dict[str, Frame] | Callable, **made: Frame) -> DataFrame:
    """Rows ``in_order`` with a column for each ``Frame``, their order kept.

    A window operator goes through a frame anew for each row and copies the rows for each frame. Here a batch's frames are views of one array,
    added up at once; of the rows before a batch the values that its frames reach back to are kept. ``steps`` come first, in the same pass: frames too,
    or a function from the columns so far (arrays, nan: none) to further ones, of which only frames become columns.
    """
    steps = [*steps, made] if made else list(steps)
    frames = [f for step in steps if isinstance(step, dict) for f in step.items()]
    reach: dict[str, int] = {}
    for _, f in frames:
        reach[f.x] = max(reach.get(f.x, 0), f.n - 1 + f.back)
    given = set(rows.columns)

    def sweep(batches):
        past = {c: np.zeros(0) for c in reach}
        for batch in batches:
            place, out, upto = batch.column("n_bars").to_numpy(), [], {}
            now = {c: batch.column(c).cast("float64").to_numpy(zero_copy_only=False) for c in reach if c in given}
            for step in steps:
                if not isinstance(step, dict):
                    now |= step(now)
                    continue
                for name, f in step.items():
                    if f.x not in upto:
                        upto[f.x] = np.concatenate([past[f.x], now[f.x]])
                    now[name] = f.over(upto[f.x], place)
                    out.append(pa.array(now[name], "float64", mask=np.isnan(now[name])))
            past = {c: v[max(0, len(v) - reach[c]) :] for c, v in upto.items()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(name for name, _ in frames)])

    return rows.mapInArrow(sweep, StructType([*rows.schema.fields, *(StructField(name, DoubleType()) for name, _ in frames)]))


def lag(x: str | Column, n: int, by=None) -> Column:
    return F.lag(x, n).over(by or by_symbol())


def true(condition: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(condition, F.lit(False))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def trunc(x: Column) -> Column:
    """Toward zero, as a long."""
    return x.cast("long")


def wilson(k: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, clipped to [0, 1]; null for n = 0."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    d = 1 + F.try_divide(F.lit(z * z), n)
    mid = (p + F.try_divide(F.lit(z * z / 2), n)) / d
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / d
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def weekdays_after(start: Column, end: Column) -> Column:
    """Monday-to-Friday days d with start <= d < end (end on or after start)."""
    monday0 = lambda d: F.weekday(d)
    days = F.datediff(end, start)
    whole = F.floor(days / 7) * 5
    rest = days % 7
    first = monday0(start)
    weekend = F.greatest(F.lit(0), F.least(first + rest, F.lit(7)) - F.greatest(first, F.lit(5))) + F.greatest(F.lit(0), first + rest - 12)
    return (whole + rest - weekend).cast("int")
