"""Smaller joins and reports around decisions, dividends, curves and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.panel import by_symbol, true, trunc, weekdays_after

C = F.col


def next_session_returns(decisions: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """decisions (symbol, day) -> log return from the first session on or after the day over ``horizon`` sessions.

    A forward as-of by union and one window: each decision reads the next bar, which carries its own later price. The window runs from the
    last day back, so that its frame only grows; a frame that ends at the last row is added up anew for each row.
    """
    priced = bars.select("symbol", C("date").alias("day"), F.struct("close", F.lead("close", horizon).over(by_symbol()).alias("later")).alias("bar"), F.lit(1).alias("is_bar"))
    asked = decisions.withColumn("bar", F.lit(None).cast("struct<close: double, later: double>")).withColumn("is_bar", F.lit(0))
    both = asked.unionByName(priced, allowMissingColumns=True)
    rows = both.withColumn("bar", F.last("bar", ignorenulls=True).over(_from_the_last("day"))).where("is_bar = 0")
    known = C("day").isNotNull() & (C("bar.close") > 0)
    return rows.withColumn("fwd", F.when(known, F.log(C("bar.later") / C("bar.close")))).drop("bar", "is_bar")


def _from_the_last(day: str):
    """Of a symbol, the rows on or after ``day``; a bar comes before what asks on its day."""
    return W.partitionBy("symbol").orderBy(F.desc(day), F.desc("is_bar")).rowsBetween(W.unboundedPreceding, 0)


def entry_exit_returns(events: DataFrame, bars: DataFrame, days: int) -> DataFrame:
    """events (symbol, day) -> simple return from the last close on or before the day to the ``days``-th close after it."""
    priced = bars.select("symbol", C("date").alias("day"), F.struct("close", F.lead("close", days).over(by_symbol()).alias("later")).alias("bar"), F.lit(0).alias("asks"))
    asked = events.withColumn("bar", F.lit(None).cast("struct<close: double, later: double>")).withColumn("asks", F.lit(1))
    both = asked.unionByName(priced, allowMissingColumns=True)
    upto = W.partitionBy("symbol").orderBy("day", "asks").rowsBetween(W.unboundedPreceding, 0)
    rows = both.withColumn("bar", F.last("bar", ignorenulls=True).over(upto)).where("asks = 1")
    return rows.withColumn("ret", F.try_divide(C("bar.later"), C("bar.close")) - 1).drop("bar", "asks")


def regime_accuracy(rows: DataFrame) -> DataFrame:
    return rows.where("ret IS NOT NULL").groupBy("regime").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), F.avg((C("ret") > 0).cast("double")).alias("share_up"))


def old_and_new(decisions: DataFrame, consensus: DataFrame) -> DataFrame:
    """(day, symbol): the winner's action beside the consensus action, a dash where there is none."""
    old = decisions.where("is_winner").groupBy(F.to_date("timestamp").alias("day"), "symbol").agg(F.max_by("action", F.struct("timestamp", "ordinal")).alias("old"))
    return old.join(consensus.select("day", "symbol", C("action").alias("new")), ["day", "symbol"], "full_outer").na.fill("-", ["old", "new"])


def crosstab(rows: DataFrame) -> DataFrame:
    share = C("n") / F.sum("n").over(W.partitionBy())
    return rows.groupBy("old", "new").agg(F.count("*").alias("n")).withColumn("share", share)


def aligned_portfolio(curves: DataFrame, by: str = "symbol", book: str = "book") -> DataFrame:
    """(book, date) -> sum of the book's curves, each carried forward from its first value, and the number of curves that have begun.

    A curve adds its change on its own dates, so the sum is a running total of the book's daily changes and no grid of dates and curves is made.
    """
    before = F.last("close", ignorenulls=True).over(W.partitionBy(book, by).orderBy("date").rowsBetween(W.unboundedPreceding, -1))
    rows = curves.withColumn("before", before)
    change = F.when(C("close").isNotNull(), C("close") - F.coalesce("before", F.lit(0.0))).otherwise(0.0)
    daily = rows.groupBy(book, "date").agg(F.sum(change).alias("change"), F.count_if(C("close").isNotNull() & C("before").isNull()).alias("begun"))
    upto = W.partitionBy(book).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    n = F.sum("begun").over(upto)
    return daily.select(book, "date", F.when(n > 0, F.sum("change").over(upto)).alias("value"), n.alias("n"))


def entry_book(plans: DataFrame) -> DataFrame:
    """plans (symbol, ordinal, action, price, target_qty): the first BUY price of the current holding; a SELL to nothing clears it."""
    upto = W.partitionBy("symbol").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    clear = ((C("action") == "SELL") & (C("target_qty") == 0)).cast("int")
    rows = plans.withColumn("clear", clear).withColumn("episode", F.coalesce(F.sum("clear").over(upto), F.lit(0)))
    rows = rows.withColumn("clears", F.sum("clear").over(W.partitionBy("symbol")))
    open_ = rows.where("episode = clears AND action = 'BUY' AND price > 0")
    return open_.groupBy("symbol").agg(F.min_by("price", "ordinal").alias("entry_price"))


def drift_alerts(live: DataFrame, walk: DataFrame, least: float = 0.5) -> DataFrame:
    """live (agent, sharpe), walk (agent, oos_sharpe per window row): agents whose live Sharpe falls short by more than ``least``."""
    oos = walk.groupBy("agent").agg(F.avg("oos_sharpe").alias("oos"))
    rows = oos.join(live.where("sharpe IS NOT NULL"), "agent").withColumn("gap", F.bround(C("oos") - C("sharpe"), 4))
    return rows.where(C("gap") > least).orderBy(F.desc("gap"))


def beta_matched(returns: DataFrame, *by: str) -> DataFrame:
    """returns (by, date, r, rb) -> beta, beta-matched excess return and its information ratio."""
    beta = returns.groupBy(*by).agg(F.regr_slope("r", "rb").alias("beta"))
    rows = returns.join(beta, list(by)).withColumn("naive", C("beta") * C("rb") + (1 - C("beta")) * 0.04 / 252).withColumn("d", C("r") - C("naive"))
    grow = lambda c: F.exp(F.sum(F.log1p(c)))
    return rows.groupBy(*by).agg(F.first("beta").alias("beta"), (grow("r") - grow("naive")).alias("excess"), (F.try_divide(F.avg("d"), F.stddev_samp("d")) * F.sqrt(F.lit(252.0))).alias("information_ratio"))


def non_overlapping(windows: DataFrame) -> DataFrame:
    """Compound return of every second window, annualised over half a year each, per symbol."""
    rows = windows.where(C("window") % 2 == 0)
    total = F.exp(F.sum(F.log1p("asset_return")))
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), (total - 1).alias("compound"), (F.pow(total, 1 / (F.count("*") * 0.5)) - 1).alias("annual"), F.percentile("asset_return", F.lit(0.5)).alias("median"))


def best_per_symbol(scores: DataFrame) -> DataFrame:
    """scores (symbol, agent, sharpe): |Sharpe| over 100 counts as missing; one best a symbol."""
    rows = scores.withColumn("sharpe", F.when(F.abs("sharpe") <= 100, C("sharpe"))).where("sharpe IS NOT NULL")
    return rows.withColumn("r", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("sharpe"), "agent"))).where("r = 1").drop("r")


def pair_profit(trades: DataFrame) -> DataFrame:
    """trades (pair, leg, side, event open/close, price, qty): profit of both legs from mean prices; incomplete without an open or close."""
    side = lambda e: F.avg(F.when(C("event") == e, C("price")))
    legs = trades.groupBy("pair", "leg", "side").agg(side("open").alias("o"), side("close").alias("c"), F.sum(F.when(C("event") == "open", C("qty"))).alias("q"))
    gain = F.when(C("side") == "SELL", C("o") - C("c")).otherwise(C("c") - C("o")) * C("q")
    return legs.withColumn("gain", gain).groupBy("pair").agg(F.sum("gain").alias("pnl"), F.max(C("gain").isNull()).alias("incomplete"))


def shadow_outcomes(signals: DataFrame, bars: DataFrame, horizons=(1, 3, 5)) -> DataFrame:
    """signals (symbol, day, action): share right by horizon in weekdays, first close on or after the n-th weekday against the close at the day."""
    rows = signals.where("action <> 'HOLD'").select("symbol", "day", "action", F.explode(F.array(*map(F.lit, horizons))).alias("h"))
    end = F.date_add("day", C("h") + F.when(F.weekday("day") + C("h") > 4, 2).otherwise(0))
    rows = rows.where(F.weekday("day") < 5).withColumn("end", end.cast("date"))
    start = next_session_prices(rows, bars, "day", "p0")
    both = next_session_prices(start, bars, "end", "p1")
    ret = C("p1") / C("p0") - 1
    right = F.when(C("action") == "BUY", ret > 0).otherwise(ret < 0)
    return both.where("p0 IS NOT NULL AND p1 IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("right"), F.avg(ret).alias("mean_ret"))


def next_session_prices(rows: DataFrame, bars: DataFrame, day: str, name: str) -> DataFrame:
    """``rows`` with the close of the symbol's first session on or after column ``day``."""
    priced = bars.select("symbol", C("date").alias(day), C("close").alias(name), F.lit(1).alias("is_bar"))
    both = rows.withColumn(name, F.lit(None).cast("double")).withColumn("is_bar", F.lit(0)).unionByName(priced, allowMissingColumns=True)
    seen = F.when(C(day).isNotNull(), F.last(name, ignorenulls=True).over(_from_the_last(day)))
    return both.withColumn(name, seen).where("is_bar = 0").drop("is_bar")


def dividend_regularity(dividends: DataFrame, on: str, years: int = 3) -> DataFrame:
    """1 - coefficient of variation over the last years, clipped to [0, 1]; .5 under two payments; special if one exceeds twice the mean."""
    day = F.lit(on).cast("date")
    rows = dividends.where((C("ex_date") <= day) & (C("ex_date") > F.add_months(day, -12 * years)))
    cv = F.try_divide(F.stddev_pop("amount"), F.avg("amount"))
    score = F.when(F.count("*") < 2, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv)))
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), score.alias("regularity"), (F.max("amount") > 2 * F.avg("amount")).alias("special"))


def independent_dates(dates: DataFrame, by: str = "agent", gap: int = 7) -> DataFrame:
    """Greedy count of dates at least ``gap`` days after the last kept one; a group is a calendar."""
    days = F.array_sort(F.collect_set(F.unix_date("date")))
    kept = F.aggregate("days", F.struct(F.lit(0).alias("n"), F.lit(-10**6).alias("last")), lambda a, d: F.when(d - a["last"] >= gap, F.struct((a["n"] + 1).alias("n"), d.alias("last"))).otherwise(a), lambda a: a["n"])
    return dates.groupBy(by).agg(days.alias("days")).select(by, F.size("days").alias("n_dates"), kept.alias("n_independent"))


def dividend_trades(rows: DataFrame) -> DataFrame:
    """rows (entry, exit, shares, dividend): profit after 15 % tax on the dividend and 4.5 bps a side, two places."""
    pnl = (C("exit") - C("entry")) * C("shares") + C("dividend") * C("shares") * 0.85 - (C("entry") + C("exit")) * C("shares") * 0.00045
    return rows.withColumn("pnl", F.round(pnl, 2))


def execution_queue(plans: DataFrame, max_notional: float, max_orders: int, buffer: float = 0.002) -> DataFrame:
    """plans (symbol, action, qty, held, price, confidence): SELLs cut to what is held, notionals to the cap in whole shares, reducing orders first, then the surest."""
    reducing = true((C("action") == "SELL") & (C("held") > 0))
    qty = F.when(reducing, F.least(C("qty"), C("held"))).otherwise(C("qty"))
    rows = plans.withColumn("reducing", reducing).withColumn("sent", trunc(F.least(qty, F.lit(max_notional) / C("price"))).cast("double")).where("sent >= 1")
    order = W.partitionBy("reducing").orderBy(F.desc("confidence"), F.desc(C("sent") * C("price")), "symbol")
    rows = rows.withColumn("place", F.row_number().over(order)).where(C("reducing") | (C("place") <= max_orders))
    limit = F.round(C("price") * F.when(C("action") == "BUY", 1 + buffer).otherwise(1 - buffer), 4)
    return rows.select("symbol", "action", "reducing", "place", "sent", limit.alias("limit"), (C("sent") != C("qty")).alias("adjusted"))


def signed_plans(signals: DataFrame, netliq: float) -> DataFrame:
    """signals (symbol, target_weight signed, price, held): one order reaches the signed target; changes under half a share hold."""
    rows = signals.withColumn("target_qty", trunc(F.lit(netliq) * C("target_weight") / C("price")).cast("double")).withColumn("delta", C("target_qty") - C("held"))
    return rows.withColumn("action", F.when(F.abs("delta") < 0.5, "HOLD").when(C("delta") > 0, "BUY").otherwise("SELL"))


def pair_plans(pairs: DataFrame, prices: DataFrame, notional: float) -> DataFrame:
    """pairs (a, b, side): two legs in whole shares, both or none."""
    legs = pairs.select("a", "b", F.inline(F.array(F.struct(C("a").alias("symbol"), C("side").alias("leg_side")), F.struct(C("b").alias("symbol"), F.when(C("side") == "BUY", "SELL").otherwise("BUY").alias("leg_side")))))
    rows = legs.join(prices, "symbol", "left").withColumn("qty", trunc(F.lit(notional) / C("price")))
    whole = F.count(F.when(C("qty") >= 1, 1)).over(W.partitionBy("a", "b"))
    return rows.withColumn("legs", whole).where("legs = 2").drop("legs")


def put_call_flags(chain: DataFrame, rf: float = 0.04, limit: float = 0.005) -> DataFrame:
    """chain (ticker, expiry, strike, right, last_price, spot, days, dividend): at the money, |C - P - (S - K e^(-rT) - D)| / S over ``limit``."""
    keys = ["ticker", "expiry", "strike"]
    side = lambda r, n: chain.where(C("right") == r).select(*keys, "spot", "days", "dividend", C("last_price").alias(n))
    both = side("C", "call").join(side("P", "put").select(*keys, "put"), keys)
    near = both.withColumn("r", F.row_number().over(W.partitionBy("ticker", "expiry").orderBy(F.abs(C("strike") - C("spot")), "strike"))).where("r = 1").drop("r")
    t = F.greatest(C("days") / 365, F.lit(1 / 365))
    gap = F.abs(C("call") - C("put") - (C("spot") - C("strike") * F.exp(-rf * t) - C("dividend"))) / C("spot")
    return near.withColumn("gap", gap).withColumn("flag", gap > limit)


def kelly_scale(weights: Column, scales: dict[str, float]) -> Column:
    """Sum of regime probability times scale; ``weights`` is a map from regime to probability."""
    table = F.create_map(*(F.lit(x) for kv in scales.items() for x in kv))
    return F.aggregate(F.map_entries(weights), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at(table, e["key"]), F.lit(0.0)))


def daily_from_windows(windows: DataFrame) -> DataFrame:
    """windows (agent, start, end, ret) -> a return for each business day, overlaps averaged, for charts and not for inference."""
    n = weekdays_after(C("start"), F.date_add("end", 1))
    rows = windows.withColumn("n", n).where("n > 0").withColumn("daily", F.pow(1 + C("ret"), 1 / C("n")) - 1)
    days = rows.select("agent", "daily", F.explode(F.sequence("start", "end")).alias("date")).where(F.weekday("date") < 5)
    return days.groupBy("agent", "date").agg(F.avg("daily").alias("ret"))


def daily_from_trips(trips: DataFrame) -> DataFrame:
    """trips (agent, entry, exit as dates, ret): the mean return of a day's exits, 0 on other business days from the first entry to the last exit."""
    span = trips.groupBy("agent").agg(F.min("entry").alias("first"), F.max("exit").alias("last"))
    days = span.select("agent", F.explode(F.sequence("first", "last")).alias("date")).where(F.weekday("date") < 5)
    booked = trips.groupBy("agent", C("exit").alias("date")).agg(F.avg("ret").alias("ret"))
    return days.join(booked, ["agent", "date"], "left").na.fill(0.0, ["ret"])
