"""Does a columnar rule say what its row rule says? Sampled points are decided again from nothing but the history up to them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantpanel.functions.panel import by_symbol

C = F.col
ONE_IN, FIRST, HISTORY = 199, 300, 260


def sampled(n: Column, symbol: Column) -> Column:
    """One row in ``ONE_IN`` by row number and symbol, alike in any engine."""
    return ((n * 7919 + F.regexp_extract(symbol, r"(\d+)$", 1).cast("long") * 104729) % ONE_IN == 0) & (n > FIRST)


def _rsi(close: np.ndarray, n: int = 14) -> float:
    moves = np.diff(close[-n - 1 :])
    loss = -moves[moves < 0].sum()
    return 100 - 100 / (1 + moves[moves > 0].sum() / loss) if loss > 0 else 0.0


def _trend(close: np.ndarray) -> str:
    fast, slow = close[-50:].mean(), close[-200:].mean()
    return "bull" if close[-1] > fast > slow else "bear" if close[-1] < fast < slow else "choppy"


def mean_reversion_row(h: pd.DataFrame) -> str:
    """Bought when oversold under the lower band on volume."""
    close, volume = h["close"].to_numpy(), h["volume"].to_numpy()
    last = close[-20:]
    lower = last.mean() - 2 * last.std(ddof=1)
    busy = volume[-1] > 1.2 * volume[-21:-1].mean()
    return "BUY" if _rsi(close) < (30 if _trend(close) == "bear" else 35) and close[-1] < lower and busy else "HOLD"


def trend_following_row(h: pd.DataFrame, n: int = 14) -> str:
    """Bought when the averages are stacked upward and the trend is strong."""
    close, high, low = (h[c].to_numpy() for c in ("close", "high", "low"))
    a, b, c = close[-20:].mean(), close[-50:].mean(), close[-200:].mean()
    if _trend(close) == "bear" or not close[-1] > a > b > c or not close[-1] / close[-21] - 1 > 0.01:
        return "HOLD"
    rise, fall = np.maximum(high[1:] - high[:-1], 0), np.maximum(low[:-1] - low[1:], 0)
    reach = np.maximum(high[1:] - low[1:], np.maximum(abs(high[1:] - close[:-1]), abs(low[1:] - close[:-1])))
    strength = []
    for k in range(len(rise) - n + 1, len(rise) + 1):
        r, up, down = reach[k - n : k].mean(), rise[k - n : k].mean(), fall[k - n : k].mean()
        p, m = 100 * up / r, 100 * down / r
        strength.append(100 * abs(p - m) / (p + m))
    return "BUY" if np.mean(strength) > 25 else "HOLD"


ROW_RULES: dict[str, Callable[[pd.DataFrame], str]] = {"mean_reversion": mean_reversion_row, "trend_following": trend_following_row}


def equivalence(bars: DataFrame, signals: DataFrame, rules: dict[str, Callable[[pd.DataFrame], str]]) -> DataFrame:
    """(agent, n_points, n_mismatches): ``rules`` against the actions in ``signals`` (symbol, date, agent, action) at sampled points.

    A point gets the ``HISTORY`` rows up to it by equality on (symbol, row); later rows never reach its rule. A missing action is a mismatch.
    """
    rows = bars.withColumn("n", F.row_number().over(by_symbol())).select("symbol", "date", "n", "high", "low", "close", "volume")
    points = rows.where(sampled(C("n"), C("symbol"))).select("symbol", C("date").alias("at"), F.explode(F.sequence(F.greatest(F.lit(1), C("n") - HISTORY + 1), C("n"))).alias("n"))
    history = points.join(rows, ["symbol", "n"])

    def decide(key, g: pd.DataFrame) -> pd.DataFrame:
        h = g.sort_values("n")
        return pd.DataFrame({"symbol": key[0], "date": key[1], "agent": list(rules), "want": [rule(h) for rule in rules.values()]})

    want = history.groupBy("symbol", "at").applyInPandas(decide, "symbol string, date date, agent string, want string")
    both = want.join(signals.select("symbol", "date", "agent", "action"), ["symbol", "date", "agent"], "left")
    return both.groupBy("agent").agg(F.count("*").alias("n_points"), F.count_if(~C("want").eqNullSafe(C("action"))).cast("int").alias("n_mismatches"))
