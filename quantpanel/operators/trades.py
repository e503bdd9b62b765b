"""Decision and execution logs: round trips, fills, positions, performance, breaker, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.panel import true, trunc

C = F.col
COST = 0.0009
BY_TIME = ("timestamp", "ordinal")


def fill_price() -> Column:
    """avg_fill_price if positive, else the limit, else the last price (a zero or missing one falls through)."""
    return F.coalesce(*(F.when(C(c) > 0, C(c)) for c in ("avg_fill_price", "limit_price", "last_price")))


def winners(decisions: DataFrame) -> DataFrame:
    """(plan_id, symbol) -> agent, regime of the last winning row."""
    return decisions.where("is_winner").groupBy("plan_id", "symbol").agg(F.max_by(F.struct("agent", "regime"), F.struct(*BY_TIME)).alias("w")).select("plan_id", "symbol", "w.agent", "w.regime")


def round_trips(executions: DataFrame, won: DataFrame, drop_unfilled_sells: bool = True) -> DataFrame:
    """First-in-first-out pairs of BUY and SELL per symbol, by windows alone.

    With net = running BUYs - SELLs and m = min(0, running minimum of net), a SELL is accepted iff m did not fall, its number is SELLs + m,
    and it closes the BUY of that number. BUYs that no winner explains are not opened; unfilled rows vanish before.
    """
    rows = executions.where("symbol IS NOT NULL").join(won, ["plan_id", "symbol"], "left").withColumn("price", fill_price())
    filled = C("avg_fill_price") > 0
    keep = filled if drop_unfilled_sells else filled | (C("side") == "SELL")
    rows = rows.where(keep).where((C("side") == "SELL") | ((C("side") == "BUY") & C("agent").isNotNull()))
    w = W.partitionBy("symbol").orderBy(*BY_TIME)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("b", (C("side") == "BUY").cast("int")).withColumn("buys", F.sum("b").over(upto)).withColumn("sells", F.sum(1 - C("b")).over(upto))
    rows = rows.withColumn("m", F.least(F.lit(0), F.min(C("buys") - C("sells")).over(upto))).withColumn("m0", F.coalesce(F.lag("m").over(w), F.lit(0)))
    buys = rows.where("b = 1").select("symbol", C("buys").alias("k"), "agent", "regime", C("price").alias("entry_price"), C("timestamp").alias("entry_ts"))
    sells = rows.where("b = 0 AND m = m0").select("symbol", (C("sells") + C("m")).alias("k"), C("price").alias("exit_price"), C("timestamp").alias("exit_ts"))
    out = buys.join(sells, ["symbol", "k"]).withColumn("ret", C("exit_price") / C("entry_price") - 1)
    return out.withColumn("holding_days", F.greatest(F.lit(1), F.datediff("exit_ts", "entry_ts")))


def trip_metrics(trips: DataFrame, rf: float = 0.04) -> DataFrame:
    """Per agent: n, win rate, mean, total, holding, trade Sharpe (three trips at least, population deviation), maximum drawdown in exit order."""
    w = W.partitionBy("agent").orderBy("exit_ts", "symbol", "k")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = trips.withColumn("curve", F.exp(F.sum(F.log1p("ret")).over(upto))).withColumn("dd", C("curve") / F.greatest(F.lit(1.0), F.max("curve").over(upto)) - 1)
    hold, sd = F.avg("holding_days"), F.stddev_pop("ret")
    sharpe = F.when(F.count("*") < 3, None).when(sd == 0, 0.0).otherwise(F.try_divide(F.avg("ret") - rf * hold / 252, sd) * F.sqrt(252 / hold))
    return rows.groupBy("agent").agg(F.count("*").alias("n"), F.avg((C("ret") > 0).cast("double")).alias("win_rate"), F.avg("ret").alias("mean_ret"), F.sum("ret").alias("total_ret"), hold.alias("avg_hold"), sharpe.alias("sharpe"), F.min("dd").alias("max_drawdown"))


def half_kelly(trips: DataFrame, least: int = 5, by: str = "agent") -> DataFrame:
    """(p*b - q) / b / 2 clipped to [0, .25] on returns net of cost; 0 without an edge, null under ``least`` trips."""
    net = C("ret") - COST
    win, loss = F.avg(F.when(net > 0, net)), F.avg(F.when(net <= 0, -net))
    p = F.avg((net > 0).cast("double"))
    b = F.try_divide(win, loss)
    f = F.when((F.avg(net) <= 0) | b.isNull(), 0.0).otherwise(F.least(F.lit(0.25), F.greatest(F.lit(0.0), F.try_divide(p * b - (1 - p), b) / 2)))
    return trips.groupBy(by).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, f).alias("half_kelly"))


def fill_stats(executions: DataFrame) -> DataFrame:
    filled = C("avg_fill_price") > 0
    slip = lambda c: F.avg(F.when(c, C("slippage_bps")))
    return executions.agg(
        F.count("*").alias("n"), F.avg(filled.cast("double")).alias("fill_rate"), slip(filled).alias("slippage"), slip(filled & (C("side") == "BUY")).alias("slippage_buy"),
        slip(filled & (C("side") == "SELL")).alias("slippage_sell"), F.max(F.when(filled, C("slippage_bps"))).alias("worst"),
    )


def net_positions(executions: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Position before plus signed filled quantities; sizes of 1e-9 or less go."""
    moves = executions.where("avg_fill_price > 0").select("symbol", F.when(C("side") == "BUY", C("qty")).otherwise(-C("qty")).alias("qty"))
    rows = moves if before is None else moves.unionByName(before.select("symbol", "qty"))
    return rows.groupBy("symbol").agg(F.sum("qty").alias("qty")).where("abs(qty) > 1e-9")


def reconcile(expected: DataFrame, actual: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Symbols whose actual position is off by more than ``tolerance``; a missing side is 0. Every row tells how many were checked."""
    both = expected.select("symbol", C("qty").alias("expected")).join(actual.select("symbol", C("qty").alias("actual")), "symbol", "full_outer").na.fill(0.0)
    n = both.agg(F.count("*").alias("n_checked"))
    return both.withColumn("drift", C("actual") - C("expected")).where(F.abs("drift") > tolerance).join(F.broadcast(n))


def entry_prices(symbols: DataFrame, plans: DataFrame, broker: DataFrame, executions: DataFrame) -> DataFrame:
    """Plan price, else the broker's average cost (> 0), else the last filled BUY price."""
    last = executions.where("side = 'BUY' AND avg_fill_price > 0").groupBy("symbol").agg(F.max_by("avg_fill_price", F.struct(*BY_TIME)).alias("last_price"))
    rows = symbols.join(plans, "symbol", "left").join(broker, "symbol", "left").join(last, "symbol", "left")
    return rows.select("symbol", F.coalesce("plan_price", F.when(C("avg_cost") > 0, C("avg_cost")), "last_price").alias("entry_price"))


def stop_losses(positions: DataFrame, entries: DataFrame, last_close: DataFrame, stop: float = 0.07) -> DataFrame:
    """Long positions whose loss exceeds ``stop``: full SELL orders."""
    rows = positions.where("qty > 0").join(entries, "symbol").join(last_close, "symbol").withColumn("pnl", C("close") / C("entry_price") - 1)
    return rows.where(C("pnl") < -stop).select("symbol", F.lit("SELL").alias("action"), "qty", "pnl")


def drawdown_breaker(equity: DataFrame, key: str = "account", order: str = "date") -> DataFrame:
    """Level 1 beyond 4 %, 2 beyond 6 %, 3 beyond 8 % below the running peak; level 3 stays."""
    upto = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = equity.withColumn("peak", F.max("netliq").over(upto)).withColumn("drawdown", 1 - C("netliq") / C("peak"))
    d = C("drawdown")
    rows = rows.withColumn("level", F.when(d > 0.08, 3).when(d > 0.06, 2).when(d > 0.04, 1).otherwise(0))
    return rows.withColumn("level", F.when(F.max(C("level") == 3).over(upto), 3).otherwise(C("level")))


def series_metrics(returns: DataFrame, by: str, rf: float = 0.04) -> DataFrame:
    """n, Sharpe, Sortino (root mean square of negative excess), volatility, annual and total return; null under 5 rows."""
    x = C("ret") - rf / 252
    n = F.count("ret")
    down = F.sqrt(F.avg(F.when(x < 0, x * x).otherwise(0.0)))
    total = F.exp(F.sum(F.log1p("ret"))) - 1
    ok = lambda c: F.when(n >= 5, c)
    return returns.where("ret IS NOT NULL").groupBy(by).agg(
        n.alias("n"), ok(F.try_divide(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(252.0))).alias("sharpe"), ok(F.try_divide(F.avg(x), down) * F.sqrt(F.lit(252.0))).alias("sortino"),
        ok(F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("volatility"), ok(total).alias("total_return"), ok(F.pow(1 + total, F.lit(252.0) / n) - 1).alias("annual_return"),
    )


def transaction_cost(qty: Column, price: Column) -> Column:
    """max(1, .005 a share) plus 5 bps of notional; 0 without quantity or price."""
    return F.when((qty == 0) | (price <= 0), 0.0).otherwise(F.greatest(F.lit(1.0), 0.005 * F.abs(qty)) + F.abs(qty) * price * 0.0005)


def slippage_bps(side: Column, fill: Column, reference: Column) -> Column:
    """Positive is unfavourable on either side; 0 without a price."""
    move = F.try_divide(fill - reference, reference) * 10_000
    return F.when((fill <= 0) | (reference <= 0), 0.0).when(side == "BUY", move).otherwise(-move)


def order_plans(signals: DataFrame, account: DataFrame, held: DataFrame, prices: DataFrame) -> DataFrame:
    """SELL closes the position, HOLD and weights <= 0 do nothing, BUY aims at int(netliq * weight / price) shares."""
    rows = signals.join(prices, "symbol").join(held, "symbol", "left").na.fill(0.0, ["qty"]).join(F.broadcast(account))
    target = F.when(C("action") == "SELL", 0.0).otherwise(trunc(C("netliq") * C("target_weight") / C("price")).cast("double"))
    act = (C("action") == "SELL") & (C("qty") > 0) | (C("action") == "BUY") & (C("target_weight") > 0)
    rows = rows.where(true(act)).withColumn("target_qty", target).withColumn("delta_qty", C("target_qty") - C("qty"))
    return rows.where("delta_qty <> 0").select("symbol", "action", "qty", "target_qty", "delta_qty", F.abs(C("delta_qty") * C("price")).alias("est_notional"), transaction_cost(C("delta_qty"), C("price")).alias("est_cost"))


def sharpe_weights(sharpes: DataFrame, base: float = 0.10) -> DataFrame:
    """base * s / mean of the positive ones, clipped to [.02, .25]; .02 for s <= 0. Columns symbol, agent, sharpe."""
    mean = F.avg(F.when(C("sharpe") > 0, C("sharpe"))).over(W.partitionBy("symbol"))
    w = F.when(C("sharpe") > 0, F.greatest(F.lit(0.02), F.least(F.lit(0.25), base * C("sharpe") / mean))).otherwise(0.02)
    return sharpes.withColumn("weight", w)
