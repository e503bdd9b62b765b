"""Does a signal beat the unconditional base rate? Labels, base rates, edge tables, calibration, intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.panel import wilson
from quantpanel.sources.scratch import written

MATERIAL = 0.0030
MIN_DATES = 60
C = F.col


def success(action: Column, fwd: Column, material: float = MATERIAL, with_hold: bool = False) -> Column:
    """1 / 0, null for HOLD (unless ``with_hold``: right within the materiality) and for a missing return."""
    out = F.when(fwd.isNull(), F.lit(None).cast("int")).when(action == "BUY", (fwd > material).cast("int")).when(action == "SELL", (fwd < -material).cast("int"))
    return out.when(action == "HOLD", (F.abs(fwd) <= material).cast("int")) if with_hold else out


def long_returns(returns: DataFrame, horizons=(1, 5, 20)) -> DataFrame:
    """fwd_h columns -> rows (symbol, date, horizon, fwd)."""
    return returns.select("symbol", "date", F.inline(F.array(*(F.struct(F.lit(h).alias("horizon"), C(f"fwd_{h}").alias("fwd")) for h in horizons))))


def base_rates(returns: DataFrame, signals: DataFrame) -> DataFrame:
    """horizon, base_buy, base_sell, base_mean over all symbols on the dates that carry any signal."""
    dates = signals.select("date").distinct()
    rows = returns.where("fwd IS NOT NULL").join(dates, "date", "left_semi")
    rate = lambda c: F.avg(c.cast("double"))
    return rows.groupBy("horizon").agg(rate(C("fwd") > MATERIAL).alias("base_buy"), rate(C("fwd") < -MATERIAL).alias("base_sell"), F.avg("fwd").alias("base_mean"))


def labelled(signals: DataFrame, returns: DataFrame) -> DataFrame:
    """Directional signals with their forward returns and labels; rows without a return are left out. Signals that carry fwd_h columns need no join."""
    rows = signals.where("action <> 'HOLD'")
    own = [c for c in signals.columns if c.startswith("fwd_")]
    if own:
        rows = rows.select("*", F.inline(F.array(*(F.struct(F.lit(int(c[4:])).alias("horizon"), C(c).alias("fwd")) for c in own)))).drop(*own).where("fwd IS NOT NULL")
    else:
        rows = rows.join(returns, ["symbol", "date"]).where("fwd IS NOT NULL")
    return rows.withColumn("hit", success(C("action"), C("fwd")))


def agent_edge(signals: DataFrame, returns: DataFrame) -> DataFrame:
    """Per (agent, horizon): counts, hit rate, expected rate, excess, Wilson bounds, verdict. Agents without directional signals have a row of zeros."""
    base = base_rates(returns, signals)
    rows = labelled(signals, returns)
    agg = rows.groupBy("agent", "horizon").agg(
        F.count("*").alias("n"), F.countDistinct("date").alias("n_dates"), F.count_if(C("action") == "BUY").alias("n_buy"), F.count_if(C("action") == "SELL").alias("n_sell"), F.sum("hit").alias("hits")
    )
    every = signals.select("agent").distinct().join(F.broadcast(base))  # a row per horizon
    out = every.join(agg, ["agent", "horizon"], "left").na.fill(0, ["n", "n_dates", "n_buy", "n_sell", "hits"])
    out = out.withColumn("hit", F.try_divide(C("hits"), C("n"))).withColumn("expected", F.try_divide(C("n_buy") * C("base_buy") + C("n_sell") * C("base_sell"), C("n")))
    low, high = wilson(C("hits"), C("n"))
    out = out.withColumn("excess", C("hit") - C("expected")).withColumn("wilson_low", low).withColumn("wilson_high", high)
    return out.select("agent", "horizon", "n", "n_dates", "n_buy", "n_sell", "hit", "expected", "excess", "wilson_low", "wilson_high")


def verdict(n_dates: Column, low: Column, high: Column) -> Column:
    return F.when(n_dates < MIN_DATES, "insufficient").when(low > 0, "edge").when(high < 0, "anti-edge").otherwise("indistinguishable")


def signed_return_edge(signals: DataFrame, returns: DataFrame) -> DataFrame:
    """Per (agent, horizon): mean signed return, passive mean, bias-corrected skew, win/loss ratio."""
    rows = labelled(signals, returns).withColumn("signed", F.when(C("action") == "BUY", C("fwd")).otherwise(-C("fwd")))
    n = F.count("*")
    skew = F.when(n > 2, F.skewness("signed") * F.sqrt(n * (n - 1)) / (n - 2))
    win, loss = F.avg(F.when(C("signed") > 0, C("signed"))), F.avg(F.when(C("signed") < 0, C("signed")))
    out = rows.groupBy("agent", "horizon").agg(n.alias("n"), F.avg("signed").alias("mean_signed"), skew.alias("skew"), F.abs(F.try_divide(win, loss)).alias("win_loss"))
    return out.join(F.broadcast(base_rates(returns, signals).select("horizon", C("base_mean").alias("passive_mean"))), "horizon")


def calibration(signals: DataFrame, returns: DataFrame, horizon: int = 5) -> DataFrame:
    """Hit rate by confidence bin [lo, hi); empty bins are left out."""
    rows = labelled(signals, returns.where(C("horizon") == horizon)).where(C("horizon") == horizon)
    edges = ((0.0, 0.55), (0.55, 0.65), (0.65, 0.75), (0.75, 0.85), (0.85, 1.01))
    bin_ = F.coalesce(*(F.when((C("confidence") >= lo) & (C("confidence") < hi), F.lit(lo)) for lo, hi in edges))
    return rows.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy("agent", "bin").agg(F.count("*").alias("n"), F.countDistinct("date").alias("n_dates"), F.avg("confidence").alias("mean_conf"), F.avg("hit").alias("hit_rate"))


def reliability(signals: DataFrame, returns: DataFrame, horizon: int = 5, buckets: int = 5) -> DataFrame:
    """Hit rate by quantile bucket (lo, hi] of confidence, the lowest edge included; equal edges merge; agents with 5 rows and 2 buckets at least."""
    rows = labelled(signals, returns.where(C("horizon") == horizon)).where(C("horizon") == horizon)
    shares = [k / buckets for k in range(buckets + 1)]
    edges = rows.groupBy("agent").agg(F.array_distinct(F.percentile("confidence", F.array(*map(F.lit, shares)))).alias("edges"), F.count("*").alias("total")).where("total >= 2 * 5 AND size(edges) >= 3")
    rows = rows.join(F.broadcast(edges), "agent")
    bucket = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < C("confidence"))))
    return rows.withColumn("bucket", bucket).groupBy("agent", "bucket").agg(F.count("*").alias("n"), F.avg("hit").alias("hit"), F.percentile("confidence", F.lit(0.5)).alias("median_conf"))


def regime_excess(signals: DataFrame, returns: DataFrame, drawdowns: DataFrame, horizon: int = 5, least: int = 50) -> DataFrame:
    """Mean forward return of BUY signals less the base mean of the same market-drawdown bucket; null under ``least`` signals. Signals that carry fwd_h columns need no join."""
    d = C("drawdown")
    bucket = F.when(d < 0.05, "0-5").when(d < 0.10, "5-10").when(d < 0.20, "10-20").otherwise("20+")
    by_date = drawdowns.where("drawdown IS NOT NULL").select("date", bucket.alias("bucket"))
    all_rows = returns.where((C("horizon") == horizon) & C("fwd").isNotNull()).join(by_date, "date")
    base = all_rows.groupBy("bucket").agg(F.avg("fwd").alias("base"))
    bought = signals.where("action = 'BUY'")
    if f"fwd_{horizon}" in signals.columns:
        bought = bought.withColumn("fwd", C(f"fwd_{horizon}")).where("fwd IS NOT NULL").join(by_date, "date")
    else:
        bought = bought.join(all_rows, ["symbol", "date"])
    own = bought.groupBy("agent", "bucket").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"))
    return own.join(F.broadcast(base), "bucket").select("agent", "bucket", "n", F.when(C("n") >= least, C("mean") - C("base")).alias("excess"))


PRIME = 2147483647


def drawn(draw, block, seed: int):
    """A whole number under ``PRIME`` for a draw and a block (columns or arrays of long), by products of whole numbers that any engine repeats."""
    x = (draw * 48271 + block * 69621 + seed) % PRIME
    x = (x * 16807 + 12345) % PRIME
    x = (x * x + 7) % PRIME
    return (x * 48271 + 1) % PRIME


DRAWS_A_TASK = 50


def block_draws(series: DataFrame, by: list[str], block: Column, draws: int, seed: int, sums: dict[str, str]) -> DataFrame:
    """Circular block bootstrap: (by.., draw, n, sums..) of ``draws`` resamples of each group of ``series`` (by.., date, columns to add up).

    A resample is n rows in blocks of ``block`` rows whose starts are ``drawn``; the last block is cut to fit. A group is as long as the
    calendar, so its running sums fit in an array, and a block's sum is a difference of two of them. Draws are dealt out in slices, each of
    which carries the group's running sums once.
    """
    one = W.partitionBy(*by).orderBy("date")
    rows = series.withColumn("i", F.row_number().over(one)).withColumns({k: F.sum(C(c).cast("double")).over(one.rowsBetween(W.unboundedPreceding, 0)) for k, c in sums.items()})
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", *sums))).alias("marks"))
    groups = groups.select(*by, "n", block.cast("long").alias("block"), *(F.concat(F.array(F.lit(0.0)), C("marks")[k]).alias(f"{k}_upto") for k in sums))
    slices = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS_A_TASK)))).repartition(*by, "slice")

    def resample(n: pd.Series, width: pd.Series, first: pd.Series, *upto: pd.Series) -> pd.Series:
        out = []
        for size, wide, low, *sums_upto in zip(n, width, first, *upto):
            draw, part = np.arange(low, min(low + DRAWS_A_TASK, draws)), np.arange(-(-size // wide))
            start = drawn(draw[:, None], part[None, :], seed) % size
            end = start + np.minimum(wide, size - part * wide)[None, :]
            wraps = end > size
            end = np.where(wraps, end - size, end)
            found = [(u[end] - u[start] + np.where(wraps, u[size], 0.0)).sum(axis=1) for u in sums_upto]
            out.append([(int(d), *map(float, f)) for d, *f in zip(draw, *found)])
        return pd.Series(out)

    resample.__annotations__ = {"n": pd.Series, "width": pd.Series, "first": pd.Series, "upto": pd.Series, "return": pd.Series}
    made = F.pandas_udf(resample, f"array<struct<draw: int, {', '.join(f'{k}: double' for k in sums)}>>")
    return slices.select(*by, "n", F.inline(made("n", "block", "slice", *(f"{k}_upto" for k in sums))))


def mean_interval(series: DataFrame, value: str, by: list[str], block: int, draws: int = 2000, seed: int = 1, least: int = 30) -> DataFrame:
    """Per group of a series (by.., date, ``value``): n, mean, the 95 % interval of the resampled mean and whether it leaves zero. Groups under ``least`` rows go."""
    series = series.where(C(value).isNotNull())
    boot = block_draws(series, by, F.lit(block), draws, seed, {"total": value}).where(C("n") >= least)
    shares = F.percentile(C("total") / C("n"), F.array(F.lit(0.025), F.lit(0.975)))
    bounds = boot.groupBy(*by).agg(shares.alias("q"))
    out = series.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(bounds, by)
    low, high = C("q")[0], C("q")[1]
    return out.select(*by, "n", "mean", low.alias("low"), high.alias("high"), F.when(low > 0, "positive").when(high < 0, "negative").otherwise("none").alias("verdict"))


def excess_intervals(signals: DataFrame, returns: DataFrame, draws: int = 2000, seed: int = 1) -> DataFrame:
    """95 % circular block-bootstrap interval of the excess per (agent, horizon), blocks of ``horizon`` dates. Dates are summed first; a group is as long as the calendar."""
    rows = labelled(signals, returns).join(base_rates(returns, signals), "horizon")
    rows = rows.withColumn("expected", F.when(C("action") == "BUY", C("base_buy")).otherwise(C("base_sell")))
    by = ["agent", "horizon"]
    daily = rows.groupBy(*by, "date").agg(F.count("*").alias("n_rows"), (F.sum("hit") - F.sum("expected")).alias("gap"))
    daily = written(daily.withColumn("gap", F.round("gap", 9)), "daily-gaps")  # a few rows a date
    boot = block_draws(daily, by, C("horizon"), draws, seed, {"gap": "gap", "rows": "n_rows"})
    bounds = boot.where("n >= 2").groupBy(*by).agg(F.percentile(C("gap") / C("rows"), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    out = daily.groupBy(*by).agg(F.count("*").alias("n_dates"), (F.sum("gap") / F.sum("n_rows")).alias("excess")).join(bounds, by, "left")
    out = out.select(*by, "n_dates", "excess", C("q")[0].alias("low"), C("q")[1].alias("high"))
    return out.withColumn("verdict", verdict(C("n_dates"), C("low"), C("high")))
