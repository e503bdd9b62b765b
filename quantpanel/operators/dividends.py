"""Dividend rules over a table of upcoming payments, a row per symbol and day.

Columns: days_to_ex, amount (of a payment), price, regularity (0 to 1), special, vol_ratio, mispriced, net_edge, held, entry_price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
LEAST_YIELD = 0.003


def confidence() -> Column:
    """Additive score, at most 1, to four places."""
    points = [
        F.when(C("net_edge") > 0, 0.30).otherwise(0.0), F.least(F.lit(0.20), C("regularity") * 0.20), F.when(C("days_to_ex").between(3, 7), 0.15).otherwise(0.0),
        F.when(~C("special"), 0.15).otherwise(0.0), F.when(C("vol_ratio") > 1, 0.10).otherwise(0.0), F.when(C("mispriced"), 0.10).otherwise(0.0),
    ]
    return F.round(F.least(sum(points[1:], points[0]), F.lit(1.0)), 4)


def payment_yield() -> Column:
    return F.when(C("price") > 0, C("amount") / C("price")).otherwise(0.0)


def capture_signals(rows: DataFrame, least_confidence: float = 0.50, take_profit: float = 1.5, stop: float = 2.0) -> DataFrame:
    """Held: SELL from the day after the ex-date, over entry + 1.5 payments, under entry - 2 payments. Else BUY two to seven days ahead where yield, edge and confidence suffice."""
    rows = rows.withColumn("confidence", confidence())
    reason = F.when(C("days_to_ex") <= -1, "after").when(C("price") > C("entry_price") + take_profit * C("amount"), "profit").when(C("price") < C("entry_price") - stop * C("amount"), "stop")
    buy = C("days_to_ex").between(2, 7) & (payment_yield() >= LEAST_YIELD) & (C("net_edge") > 0) & (C("confidence") >= least_confidence)
    rows = rows.withColumn("reason", F.when(C("held"), reason))
    action = F.when(C("held") & C("reason").isNotNull(), "SELL").when(~C("held") & buy, "BUY").otherwise("HOLD")
    return rows.withColumn("action", action).withColumn("target_weight", F.when(C("action") == "BUY", 0.08).otherwise(0.0))


def window_signals(rows: DataFrame, days_before: int = 3) -> DataFrame:
    """The simple rule: BUY at most ``days_before`` days ahead, SELL a held name after its ex-date."""
    y = payment_yield()
    sell = C("held") & (C("days_to_ex") < 0)
    buy = ~C("held") & (C("days_to_ex") > 0) & (C("days_to_ex") <= days_before) & (y >= LEAST_YIELD)
    rows = rows.withColumn("action", F.when(sell, "SELL").when(buy, "BUY").otherwise("HOLD"))
    return rows.withColumn("confidence", F.when(sell, 0.90).when(buy, F.least(F.lit(0.85), 0.60 + 50 * y)).otherwise(0.2))


def calendar(rows: DataFrame, notional: float = 10_000.0) -> DataFrame:
    """Payments of the next 30 days: the edge on ``notional`` and whether the entry window is open. The caller orders by days_to_ex."""
    ahead = rows.where(C("days_to_ex").between(0, 30))
    return ahead.withColumn("edge", notional * C("net_edge")).withColumn("active", C("days_to_ex").between(2, 7))
