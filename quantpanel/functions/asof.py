"""Joins on time whose work grows with the rows, not with rows times intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

C = F.col


def last_before(rows: DataFrame, marks: DataFrame, by: str, at: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the newest ``value`` of ``marks`` on or before ``at`` within ``by`` (null: none), by one union and sort.

    Both have ``by`` and ``at``; a row meets one mark, however many its key has.
    """
    columns = rows.columns
    both = rows.select(by, at, F.lit(1).alias("_kind"), F.struct(*columns).alias("_row"), F.lit(None).cast(marks.select(value.alias("v")).schema["v"].dataType).alias(name))
    both = both.unionByName(marks.select(by, at, F.lit(0).alias("_kind"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), value.alias(name)))
    seen = F.last(name, ignorenulls=True).over(W.partitionBy(by).orderBy(at, "_kind").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(name, seen).where("_kind = 1").select("_row.*", name)


def points_inside(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str, by: tuple[str, ...] = (), days: int = 32) -> DataFrame:
    """Interval rows with the points (of the same ``by``) of [start, end) that lie inside, by equality on bins of ``days``.

    An interval stands once in each bin that it touches, so candidates beyond the result are those of its two edge bins. An end that is null
    or not after its start has no points.
    """
    bin_ = lambda c: F.floor(F.unix_date(c) / days)
    spread = intervals.where(C(end) > C(start)).withColumn("_bin", F.explode(F.sequence(bin_(C(start)), bin_(F.date_sub(C(end), 1)))))
    return spread.join(points.withColumn("_bin", bin_(C(at))), [*by, "_bin"]).where((C(at) >= C(start)) & (C(at) < C(end))).drop("_bin")
