"""Equity, risk and pair reports."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.asof import points_inside
from quantpanel.functions.blocks import in_blocks, pairs_of_blocks
from quantpanel.functions.panel import by_symbol, clip, true, weekdays_after
from quantpanel.sources.scratch import written

C = F.col


def daily_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ret", C("close") / F.lag("close", 1).over(by_symbol()) - 1)


def tail_closes(bars: DataFrame, n: int) -> DataFrame:
    """The last n rows of every symbol."""
    return bars.withColumn("r", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).where(C("r") <= n).drop("r")


def historical_var(bars: DataFrame, positions: DataFrame, days: int = 253, least: int = 21) -> DataFrame:
    """Per book VaR at 95 and 99 % and CVaR at 99 % of its long positions (book, symbol, qty) from the dates that all of them share, also as a share of their value.

    The positions' closes are written once with what their book needs; a book's rows are never brought together whole but in daily sums.
    """
    one = W.partitionBy("book", "symbol").orderBy("date")
    whole = W.partitionBy("book", "symbol")
    rows = tail_closes(bars, days).join(positions.where("qty > 0"), "symbol").select("book", "symbol", "date", "close", "qty")
    rows = rows.withColumns({"n": F.count("*").over(whole), "last": F.max_by("close", "date").over(whole), "first": F.row_number().over(one) == 1}).where(C("n") >= least)
    rows = written(rows, "book-closes")
    books = rows.where("first").groupBy("book").agg(F.count("*").alias("n_symbols"), F.sum(C("qty") * C("last")).alias("value"))
    shared = rows.withColumn("k", F.count("*").over(W.partitionBy("book", "date"))).join(books.select("book", "n_symbols"), "book").where("k = n_symbols")
    shared = shared.withColumn("ret", C("close") / F.lag("close", 1).over(one) - 1)
    pnl = written(shared.where("ret IS NOT NULL").groupBy("book", "date").agg(F.sum(C("ret") * C("qty") * C("last")).alias("pnl")), "book-pnl")
    cut = pnl.groupBy("book").agg(F.percentile("pnl", F.array(F.lit(0.05), F.lit(0.01))).alias("q"), F.count("*").alias("n_days"))
    tail = pnl.join(cut, "book").groupBy("book").agg(F.first("n_days").alias("n_days"), -F.first("q")[0].alias("var95"), -F.first("q")[1].alias("var99"), -F.avg(F.when(C("pnl") <= C("q")[1], C("pnl"))).alias("cvar99"))
    tail = tail.toDF("book", "n_days", "var95", "var99", "cvar99").join(books.select("book", "value"), "book")
    return tail.withColumn("var99_pct", C("var99") / C("value"))


def _recent_returns(bars: DataFrame, days: int) -> DataFrame:
    return daily_returns(tail_closes(bars, days + 1)).where("ret IS NOT NULL").select("symbol", "date", "ret")


#: Symbols of a block of ``correlations``: two blocks' returns and the figures of their pairs take a few hundred MB at most.
BLOCK_SYMBOLS = 500


def _block_moments(least: int):
    """Moments of all pairs of two blocks of symbols, by matrix products over their dates; a missing date weighs nothing."""

    def dense(block, place: np.ndarray, n_dates: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        sizes, at = block["sizes"].values.to_numpy(), place[block["days"].values.to_numpy() - first]
        x = np.full((n_dates, len(sizes)), np.nan)
        x[at, np.repeat(np.arange(len(sizes)), sizes)] = block["rets"].values.to_numpy()
        x -= np.nanmean(x, axis=0)  # moments lose no digits about the mean
        have = np.isfinite(x).astype(float)
        return np.where(have > 0, x, 0.0), have

    def both(left, right) -> pa.RecordBatch:
        days = [b["days"].values.to_numpy() for b in (left, right)]
        first = min(d.min() for d in days)
        seen = np.zeros(max(d.max() for d in days) - first + 1, bool)
        for d in days:
            seen[d - first] = True
        place = np.cumsum(seen) - 1
        alone = left["block"] == right["block"]
        xa, ha = dense(left, place, place[-1] + 1, first)
        xb, hb = (xa, ha) if alone else dense(right, place, place[-1] + 1, first)
        n = ha.astype(np.float32).T @ hb.astype(np.float32)  # whole numbers
        sa, sb, saa, sbb, sab = xa.T @ hb, ha.T @ xb, (xa * xa).T @ hb, ha.T @ (xb * xb), xa.T @ xb
        with np.errstate(divide="ignore", invalid="ignore"):
            va, vb = saa - sa * sa / n, sbb - sb * sb / n
            corr = np.where((va > 1e-20) & (vb > 1e-20), (sab - sa * sb / n) / np.sqrt(va * vb), np.nan)
        i, j = np.nonzero(n >= least)
        if alone:
            i, j = i[i < j], j[i < j]
        names = pa.concat_arrays([left["symbol"].values, right["symbol"].values])
        order = np.empty(len(names), np.int64)
        order[np.argsort(names.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(names))
        a, b = i, j + len(left["symbol"].values)
        a, b = np.where(order[a] > order[b], b, a), np.where(order[a] > order[b], a, b)
        return pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(n[i, j].astype(np.int64)), pa.array(np.clip(corr[i, j], -1, 1), from_pandas=True)], names=["a", "b", "n", "corr"])

    def run(batches):
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                yield both(left, right)

    return run


def correlations(bars: DataFrame, days: int = 60, least: int = 20, blocks: int | None = None) -> DataFrame:
    """(a, b, n, corr), a < b, of the last ``days`` rows' returns on the dates that a pair shares, ``least`` of them, for all pairs.

    Symbols are dealt to ``blocks``, by default as many as keep about ``BLOCK_SYMBOLS`` in each, so that the memory of a pair of blocks does not
    grow with the number of symbols. A symbol's returns are written twice, alone and in its block; tasks read the blocks that they pair.
    """
    rows = _recent_returns(bars, days).where("symbol IS NOT NULL").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("date").alias("day"), "ret"))).alias("x"))
    rows = written(rows.select("symbol", C("x.day").alias("days"), C("x.ret").alias("rets")), "recent-returns")
    if blocks is None:
        blocks = max(1, -(-rows.count() // BLOCK_SYMBOLS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"))
    held = in_blocks(rows, "block", blocks, ("days", "rets"), ("symbol",), name="return-blocks")
    return pairs_of_blocks(held).mapInArrow(_block_moments(least), "a string, b string, n long, corr double")


def pair_correlations(bars: DataFrame, pairs: DataFrame, days: int = 60, least: int = 20) -> DataFrame:
    """``correlations`` of the wanted pairs (a, b) alone."""
    rows = _recent_returns(bars, days)
    both = rows.withColumnsRenamed({"symbol": "a", "ret": "ra"}).join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "a")
    both = both.join(rows.withColumnsRenamed({"symbol": "b", "ret": "rb"}), ["b", "date"])
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("corr")).where(C("n") >= least)


def spread_stats(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per candidate pair (a, b): hedge ratio (slope of log a on log b), zero crossings of the demeaned spread, half-life of its reversion."""
    px = bars.select("symbol", "date", F.log("close").alias("p"))
    rows = px.withColumnsRenamed({"symbol": "a", "p": "pa"}).join(pairs, "a").join(px.withColumnsRenamed({"symbol": "b", "p": "pb"}), ["b", "date"])
    beta = rows.groupBy("a", "b").agg(F.regr_slope("pa", "pb").alias("beta"), F.count("*").alias("n"))
    rows = rows.join(beta, ["a", "b"]).withColumn("s", C("pa") - C("beta") * C("pb"))
    w = W.partitionBy("a", "b").orderBy("date")
    rows = rows.withColumn("side", (C("s") - F.avg("s").over(W.partitionBy("a", "b")) >= 0).cast("int")).withColumn("s0", F.lag("s").over(w)).withColumn("crossed", (C("side") != F.lag("side").over(w)).cast("int"))
    b = F.regr_slope(C("s") - C("s0"), C("s0"))
    half = F.when((F.count("s0") >= 20) & (b < 0), math.log(2) / -b)
    return rows.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("beta").alias("beta"), F.sum("crossed").alias("crossings"), half.alias("half_life"))


def spread_zscore(bars: DataFrame, pairs: DataFrame, n: int = 63) -> DataFrame:
    """pairs (a, b, beta): ln a - beta ln b (s) against its rolling mean and deviation (z); null where the deviation is under 1e-6."""
    of = lambda x: bars.select(C("symbol").alias(x), "date", F.ln("close").alias(f"p{x}"))
    rows = of("a").join(pairs, "a").join(of("b"), ["b", "date"]).withColumn("s", C("pa") - C("beta") * C("pb"))
    w = W.partitionBy("a", "b").orderBy("date").rowsBetween(1 - n, 0)
    sd = F.stddev_samp("s").over(w)
    return rows.withColumn("z", F.when((F.count("s").over(w) == n) & (sd >= 1e-6), (C("s") - F.avg("s").over(w)) / sd))


def earnings_blackout(buys: DataFrame, earnings: DataFrame, days: int = 3) -> DataFrame:
    """BUY rows (symbol, date) with an earnings date 0 to ``days`` business days ahead; one on the weekend just before blocks too.

    An earnings date stands for the few dates that it can block, so buys meet them by equality.
    """
    reach = days + 2 * -(-days // 5) + 2
    near = earnings.where("earnings_date IS NOT NULL").select("symbol", "earnings_date", F.explode(F.sequence(F.date_sub("earnings_date", reach), F.date_add("earnings_date", 2))).alias("date"))
    ahead = F.when(C("earnings_date") >= C("date"), weekdays_after(C("date"), C("earnings_date"))).otherwise(-weekdays_after(C("earnings_date"), C("date")))
    return buys.select("symbol", "date").distinct().join(near.where(ahead.between(0, days)), ["symbol", "date"], "left_semi")


def next_open_fills(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """Orders (symbol, date, side, limit) fill at the next bar's open unless it is beyond the limit."""
    nxt = bars.select("symbol", "date", F.lead("open").over(by_symbol()).alias("next_open"))
    rows = orders.join(nxt, ["symbol", "date"])
    ok = true(F.when(C("side") == "BUY", C("next_open") <= C("limit")).otherwise(C("next_open") >= C("limit")))
    return rows.withColumn("filled", ok).withColumn("fill_price", F.when(ok, C("next_open")))


def walk_forward_windows(bars: DataFrame, train: int = 378, test: int = 126, step: int = 63) -> DataFrame:
    """Per symbol the boundary dates of windows start = 0, step, ... while start + train + test <= n."""
    rows = bars.withColumn("i", F.row_number().over(by_symbol()) - 1)
    n = rows.groupBy("symbol").agg(F.count("*").alias("n")).where(C("n") >= train + test)
    wins = n.select("symbol", F.posexplode(F.sequence(F.lit(0), (C("n") - train - test).cast("int"), F.lit(step))).alias("window", "start"))
    marks = wins.select("symbol", "window", F.inline(F.array(*(F.struct(F.lit(k).alias("mark"), (C("start") + at).cast("int").alias("i")) for k, at in (("train_start", 0), ("train_end", train - 1), ("test_start", train), ("test_end", train + test - 1))))))
    dated = marks.join(rows.select("symbol", "i", "date"), ["symbol", "i"])
    return dated.groupBy("symbol", "window").pivot("mark", ["train_start", "train_end", "test_start", "test_end"]).agg(F.first("date"))


def buy_and_hold(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """Return from the first bar on or after test_start to the last on or before test_end, four places."""
    spans = windows.select("symbol", "window", "test_start", F.date_add("test_end", 1).alias("after"))
    rows = points_inside(spans, bars.select("symbol", "date", "close"), "test_start", "after", "date", ("symbol",))
    return rows.groupBy("symbol", "window").agg(F.bround(F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1, 4).alias("asset_return"))


def monthly_returns(equity: DataFrame, by: str = "symbol") -> DataFrame:
    """Month-end change, a row per year and a column per month."""
    last = equity.groupBy(by, F.year("date").alias("year"), F.month("date").alias("month")).agg(F.max_by("close", "date").alias("v"))
    change = last.withColumn("r", C("v") / F.lag("v").over(W.partitionBy(by).orderBy("year", "month")) - 1)
    return change.groupBy(by, "year").pivot("month", list(range(1, 13))).agg(F.first("r")).withColumnsRenamed({str(m): f"m{m:02d}" for m in range(1, 13)})


def dividend_net_edge(gross: Column, days: Column, vol: Column, rf: float = 0.04, tax: float = 0.15, cost: float = 0.0009, z: float = 1.645) -> Column:
    """Net of tax, carry, costs and half the tail risk."""
    return gross * (1 - tax) - rf * days / 365 - cost - 0.5 * z * vol * F.sqrt(days)


def kelly_blend(live: Column, fallback: Column, n: Column, full: int = 20) -> Column:
    """alpha = min(1, n / full) of the live value, the rest of the fallback."""
    alpha = clip(n / full, 0.0, 1.0)
    return alpha * live + (1 - alpha) * fallback


def sharpe_variants(curve: DataFrame, by: str = "symbol", rf: float = 0.04, look: int = 126) -> DataFrame:
    """curve (by, date, close): three guards around the same ratio, over all rows (engine, portfolio) or the last ``look`` (allocator)."""
    order = W.partitionBy(by).orderBy("date")
    rows = curve.withColumn("r", C("close") / F.lag("close").over(order) - 1).withColumn("back", F.row_number().over(W.partitionBy(by).orderBy(F.desc("date"))))
    ratio = lambda r: (F.avg(r) - rf / 252) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.lit(252.0))
    late = F.when(C("back") < look, C("r"))
    out = rows.groupBy(by).agg(ratio(C("r")).alias("s"), ratio(late).alias("t"), F.count("r").alias("n"), F.count(late).alias("m"))
    return out.select(
        by, F.when(F.abs("s") <= 100, C("s")).otherwise(0.0).alias("engine"), F.when(C("n") >= 5, F.round(F.coalesce(clip(C("s"), -50.0, 50.0), F.lit(0.0)), 3)).otherwise(0.0).alias("portfolio"),
        F.when(C("m") >= 5, F.coalesce(clip(C("t"), -500.0, 500.0), F.lit(0.0))).otherwise(0.0).alias("allocator"),
    )


def blended_best(backtest: DataFrame, live: DataFrame, full: int = 20) -> DataFrame:
    """backtest (agent, symbol, sharpe), live (agent, symbol, live, n): blended by trades so far, and the best agent of each symbol (ties: first name)."""
    mixed = F.when(C("live").isNull(), C("sharpe")).otherwise(kelly_blend(C("live"), C("sharpe"), C("n"), full))
    rows = backtest.join(live, ["agent", "symbol"], "left").withColumn("blended", F.round(F.round(mixed, 9), 4))
    best = F.first("agent").over(W.partitionBy("symbol").orderBy(F.desc("blended"), "agent"))
    return rows.withColumn("best", best)


def annual_return(change: Column, days: Column) -> Column:
    return F.when(days > 0, F.pow(1 + change, 252 / days) - 1).otherwise(0.0)


def daily_return(change: Column, days: Column) -> Column:
    return F.pow(1 + change, 1 / F.greatest(F.lit(1.0), days)) - 1


def pair_signals(bars: DataFrame, pairs: DataFrame, window: int = 63, entry: float = 2.0, exit: float = 0.5, stop: float = 3.5) -> DataFrame:
    """pairs (a, b, beta, extra, and ``active_until``: the last date on which the pair is cointegrated, null: still) by the z-score of their spread.

    A flat pair enters beyond ``entry``, however far; a held one is closed when the pair breaks (BREAK), beyond ``stop`` (STOP) and under
    ``exit`` (EXIT), and else waits. Whether a pair is held follows from the rows before: one under ``exit`` or after the break leaves it
    flat, one between ``entry`` and ``stop`` held, one beyond ``stop`` turns it, any other keeps it. So it is held if the last settling row says
    so, turned by the count of stops since. The side is that of the row that opened the episode; the legs are opposite. Rows without a
    z-score are left out and change nothing.
    """
    pairs = pairs if "active_until" in pairs.columns else pairs.withColumn("active_until", F.lit(None).cast("date"))
    rows = spread_zscore(bars, pairs, window).where("z IS NOT NULL")
    order = W.partitionBy("a", "b").orderBy("date")
    upto, size = order.rowsBetween(W.unboundedPreceding, 0), F.abs("z")
    broken = true(C("date") > C("active_until"))
    settles = F.when(broken | (size < exit), 0).when((size > entry) & (size <= stop), 1)
    turns = (~broken & (size > stop)).cast("int")
    rows = rows.withColumns({"broken": broken, "settles": settles, "turns": F.sum(turns).over(upto)})
    rows = rows.withColumn("settled", F.last(F.when(C("settles").isNotNull(), F.struct("settles", "turns")), ignorenulls=True).over(upto))
    after = (F.coalesce(C("settled.settles"), F.lit(0)) + C("turns") - F.coalesce(C("settled.turns"), F.lit(0))) % 2 == 1
    rows = rows.withColumn("after", after).withColumn("held", F.coalesce(F.lag("after").over(order), F.lit(False)))
    opened = F.when(C("after") & ~C("held"), F.when(C("z") > 0, "SELL").otherwise("BUY"))
    rows = rows.withColumn("side", F.last(opened, ignorenulls=True).over(upto))
    leaves = F.when(C("broken"), "BREAK").when(size > stop, "STOP").when(size < exit, "EXIT").otherwise("HOLD")
    action = F.when(C("held"), leaves).when(C("after"), "ENTER").otherwise("HOLD")
    sure = F.round(F.least(F.lit(0.93), F.least(F.lit(0.90), 0.60 + 0.1 * (size - entry)) + 0.03 * C("extra")), 3)
    rows = rows.withColumn("action", action)
    rows = rows.withColumn("confidence", F.when(C("action") == "ENTER", sure).when(C("action") == "BREAK", 0.99).when(C("action") == "STOP", 0.98).when(C("action") == "EXIT", 0.90).otherwise(0.0))
    side = F.when(C("held") | C("after"), C("side"))
    return rows.withColumn("side_a", side).withColumn("side_b", F.when(side == "SELL", "BUY").when(side == "BUY", "SELL")).select("a", "b", "date", "z", "held", "action", "confidence", "side_a", "side_b")
