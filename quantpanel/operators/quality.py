"""Price-series screening: verdict per symbol, kept and rejected rows, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantpanel.functions.panel import by_symbol

MIN_BARS, JUMP, MAX_JUMPS, MAX_RANGE = 10, 0.50, 5, 1000.0


def normalize_bars(raw: DataFrame) -> DataFrame:
    """Doubles for the price columns (an error if one is absent), Volume if there is one; rows with a null go."""
    names = {c.lower(): c for c in raw.columns}
    missing = [c for c in ("open", "high", "low", "close") if c not in names]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    prices = [c for c in ("open", "high", "low", "close", "volume") if c in names]
    keys = [c for c in raw.columns if c.lower() in ("symbol", "date")]
    return raw.select(*keys, *(F.col(names[c]).cast("string").try_cast("double").alias(c) for c in prices)).na.drop()


def assess(bars: DataFrame) -> DataFrame:
    """symbol, n, n_jumps, price_range, ok, reason. An isolated spike is two jumps, in and out."""
    nxt = F.lead("close").over(by_symbol())
    jump = F.abs(F.try_divide(nxt, F.col("close")).cast("double"))
    rows = bars.select("symbol", "close", F.coalesce((F.abs(F.log(jump)) > JUMP).cast("int"), F.lit(0)).alias("jump"))
    low, high = F.min("close"), F.max("close")
    out = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("jump").alias("n_jumps"), F.when(low <= 0, float("inf")).otherwise(F.try_divide(high, low)).alias("price_range"))
    reason = F.when(F.col("n") < MIN_BARS, "short").when(F.col("n_jumps") > MAX_JUMPS, "jumps").when((F.col("n_jumps") > 0) & (F.col("price_range") > MAX_RANGE), "range")
    return out.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def filter_universe(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars of kept symbols, verdicts of rejected ones); nothing is swallowed."""
    verdict = assess(bars)
    return bars.join(verdict.where("ok").select("symbol"), "symbol", "left_semi"), verdict.where("NOT ok")


def reject_report(verdicts: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` worst, and in every row how many more there are."""
    rest = verdicts.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("n_more"))
    return verdicts.orderBy(F.desc("n_jumps"), "symbol").limit(limit).join(F.broadcast(rest))
