"""Causal features of daily bars: every value reads the row's own symbol up to its date.

``features`` shares one partitioning and one sort by (symbol, date) among all its frames. ``FORWARD`` columns are the labels and look ahead.
Defined cases: short histories give nulls; a symbol with repeated dates is ordered as given.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantpanel.functions.panel import Frame, by_symbol, in_order, lag, rolling, swept, with_long_frames

HORIZONS = (1, 5, 20)


def forward_returns(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Log return over the next h rows of the symbol; null on its last h."""
    return bars.withColumns({f"fwd_{h}": F.log(F.lead("close", h).over(by_symbol()) / F.col("close")) for h in horizons})


def moving_averages(bars: DataFrame, lengths=(20, 50, 200)) -> DataFrame:
    return with_long_frames(bars, math.gcd(*lengths), {f"sma{n}": ("avg", "close", n) for n in lengths})


def trend_regime(rows: DataFrame) -> DataFrame:
    """bull: close > SMA50 > SMA200; bear: the reverse; else choppy. Needs sma50 and sma200."""
    c, f, s = F.col("close"), F.col("sma50"), F.col("sma200")
    return rows.withColumn("regime", F.when((c > f) & (f > s), "bull").when((c < f) & (f < s), "bear").otherwise("choppy"))


def average_true_range(bars: DataFrame, n: int = 14) -> DataFrame:
    """atr, atr_pct and vol_regime (low below .008 of the price, high above .018)."""
    rows = bars.withColumn("prev_close", lag("close", 1)).withColumn("tr", _true_range())
    return _range_regime(rows.withColumn("atr", rolling(F.avg, "tr", n)))


def _true_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close")))


def _range_regime(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("atr_pct", F.col("atr") / F.col("close"))
    return rows.withColumn("vol_regime", F.when(F.col("atr_pct") < 0.008, "low").when(F.col("atr_pct") > 0.018, "high").when(F.col("atr_pct").isNotNull(), "normal"))


def rsi(bars: DataFrame, n: int = 14, classic: bool = False) -> DataFrame:
    """Simple-mean RSI. Without a loss in the window it is 0; ``classic`` gives the usual 100."""
    rows = bars.withColumn("_before", lag("close", 1)).withColumns(_gains("_before")).drop("_before")
    rows = rows.withColumns({"gain": rolling(F.avg, "gain", n), "loss": rolling(F.avg, "loss", n)})  # a window function named once is computed once
    return rows.withColumn("rsi", _strength(classic)).drop("gain", "loss")


def _gains(before: str) -> dict[str, Column]:
    d, known = F.col("close") - F.col(before), F.col(before).isNotNull()
    return {"gain": F.when(known, F.greatest(d, F.lit(0.0))), "loss": F.when(known, F.greatest(-d, F.lit(0.0)))}


def _strength(classic: bool = False) -> Column:
    return F.when(F.col("loss") == 0, 100.0 if classic else 0.0).otherwise(100 - 100 / (1 + F.try_divide("gain", "loss")))


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    rows, mid, dev = bars.withColumns({"bb_mid": rolling(F.avg, "close", n), "_dev": rolling(F.stddev_samp, "close", n)}), F.col("bb_mid"), F.col("_dev")
    return rows.withColumns({"bb_lower": mid - width * dev, "bb_upper": mid + width * dev}).drop("_dev")


def adx(rows: DataFrame, n: int = 14) -> DataFrame:
    """Simple-mean ADX in which both directional moves may stand together. Needs tr and atr."""
    rows = rows.withColumns({"_high": lag("high", 1), "_low": lag("low", 1)}).withColumns(_moves()).drop("_high", "_low")
    rows = _directional(rows.withColumns({"pdm": rolling(F.avg, "pdm", n), "mdm": rolling(F.avg, "mdm", n)}))
    return rows.withColumn("adx", rolling(F.avg, "dx", n)).drop("dx")


def _moves() -> dict[str, Column]:
    known, up, down = F.col("_high").isNotNull(), F.col("high") - F.col("_high"), F.col("_low") - F.col("low")
    return {"pdm": F.when(known, F.greatest(up, F.lit(0.0))), "mdm": F.when(known, F.greatest(down, F.lit(0.0)))}


def _directional(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"pdi": 100 * F.try_divide("pdm", "atr"), "mdi": 100 * F.try_divide("mdm", "atr")})
    return rows.withColumn("dx", 100 * F.try_divide(F.abs(F.col("pdi") - F.col("mdi")), F.col("pdi") + F.col("mdi"))).drop("pdm", "mdm", "pdi", "mdi")


def momentum(bars: DataFrame, lags=(20, 21, 50, 62, 63, 126)) -> DataFrame:
    """close / close k rows ago - 1, and the prior 20-row high and low without today."""
    rows = bars.withColumns({f"mom{k}": F.col("close") / lag("close", k) - 1 for k in lags})
    return rows.withColumns({"prior_high20": rolling(F.max, "high", 20, back=1), "prior_low20": rolling(F.min, "low", 20, back=1)})


def volume_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    """Today's volume over the mean of the previous n."""
    return bars.withColumn("volume_ratio", F.try_divide(F.col("volume"), rolling(F.avg, "volume", n, back=1)))


def volatility(bars: DataFrame) -> DataFrame:
    """ret1, vol20, near_high252 (over what is there), drawdown60 and realized_vol (annualised, 5 returns at least)."""
    rows = bars.withColumn("ret1", F.col("close") / lag("close", 1) - 1)
    rows = with_long_frames(rows, 12, {"_year": ("max", "close", 252), "_sixty": ("max", "close", 60)})
    twenty = by_symbol().rowsBetween(-19, 0)
    rows = rows.withColumns({"_sd": F.stddev_samp("ret1").over(twenty), "_n": F.count("ret1").over(twenty)})
    return rows.withColumns({
        "vol20": F.when(F.col("_n") >= 20, F.col("_sd")), "near_high252": F.col("close") / F.col("_year"),
        "drawdown60": (F.col("_sixty") - F.col("close")) / F.col("_sixty"),
        "realized_vol": F.when(F.col("_n") >= 5, F.col("_sd")) * math.sqrt(252),
    }).drop("_year", "_sixty", "_sd", "_n")


def momentum_score(bars: DataFrame, skip: int = 21, spans=(63, 126, 252), strict: bool = False) -> DataFrame:
    """Mean of P[t-skip]/P[t-skip-p]-1 over the spans available (``strict``: null unless all are)."""
    held = [f"_back{p}" for p in (0, *spans)]
    bars = bars.withColumns({c: lag("close", skip + p) for c, p in zip(held, (0, *spans))})
    return bars.withColumn("mom_score", _score(held, strict)).drop(*held)


def _score(held: list[str], strict: bool = False) -> Column:
    parts = [F.col(held[0]) / F.col(c) - 1 for c in held[1:]]
    have = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.when(have >= (len(parts) if strict else 1), total / have)


def market_drawdown(bars: DataFrame, n: int = 252, least: int = 60) -> DataFrame:
    """Distance below the rolling high; null before ``least`` rows."""
    return bars.withColumn("drawdown", 1 - F.col("close") / rolling(F.max, "close", n, least))


def index_extremes(bars: DataFrame) -> DataFrame:
    """Volatility-index features: z-score against up to 252 rows, 5-row momentum, ratio to SMA20; neutral under 30 rows."""
    frame = by_symbol().rowsBetween(-251, 0)
    enough = F.count("close").over(frame) >= 30
    z = F.try_divide(F.col("close") - F.avg("close").over(frame), F.stddev_samp("close").over(frame))
    return bars.withColumns({
        "vix_z": F.when(enough, F.coalesce(z, F.lit(0.0))).otherwise(0.0), "vix_mom5": F.when(enough, F.col("close") / lag("close", 5) - 1).otherwise(0.0),
        "vix_ratio": F.when(enough, F.col("close") / rolling(F.avg, "close", 20)).otherwise(1.0),
    })


def regime_matrix(rows: DataFrame) -> DataFrame:
    """vol_5d, vol_21d, mom_10d, mom_30d, ret_21d, atr_pct; rows with a null are dropped. Needs ret1 and atr_pct."""
    names = ["vol_5d", "vol_21d", "mom_10d", "mom_30d", "ret_21d"]
    out = rows.withColumns({
        "vol_5d": rolling(F.stddev_samp, "ret1", 5) * math.sqrt(252), "vol_21d": rolling(F.stddev_samp, "ret1", 21) * math.sqrt(252),
        "mom_10d": F.col("close") / lag("close", 10) - 1, "mom_30d": F.col("close") / lag("close", 30) - 1, "ret_21d": rolling(F.sum, "ret1", 21),
    })
    return out.select("symbol", "date", *names, "atr_pct").na.drop()


def volatility_sizing(bars: DataFrame, weight: float = 0.10) -> DataFrame:
    """Halves the weight where the 20-row volatility of log returns is over twice the 252-row one (272 closes at least)."""
    rows = bars.withColumn("lr", F.log(F.col("close") / lag("close", 1))).withColumn("n", F.row_number().over(by_symbol()))
    ratio = F.try_divide(rolling(F.stddev_samp, "lr", 20), rolling(F.stddev_samp, "lr", 252))
    return rows.withColumn("sized_weight", F.when((F.col("n") >= 272) & (ratio > 2), F.round(F.lit(weight / 2), 4)).otherwise(F.lit(weight))).drop("lr", "n")


MOMENTUM = (20, 21, 50, 62, 63, 126)


def _ranges_and_moves(x: dict) -> dict:
    """``_true_range``, ``_gains``, ``_moves`` and the return of the rows of a sweep."""
    up = lambda v, known: np.where(np.isnan(known), np.nan, np.fmax(v, 0.0))
    high, low, close, before = x["high"], x["low"], x["close"], x["_lag1"]
    with np.errstate(divide="ignore", invalid="ignore"):
        ret1 = close / np.where(before == 0, np.nan, before) - 1
    return {
        "tr": np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before)), "gain": up(close - before, before), "loss": up(before - close, before),
        "pdm": up(high - x["_high"], x["_high"]), "mdm": up(x["_low"] - low, x["_high"]), "ret1": ret1,
    }


def _directions(x: dict) -> dict:
    """``_directional`` of the rows of a sweep."""
    atr = np.where(x["atr"] == 0, np.nan, x["atr"])
    pdi, mdi = 100 * (x["_pdm"] / atr), 100 * (x["_mdm"] / atr)
    both = pdi + mdi
    return {"dx": 100 * (np.abs(pdi - mdi) / np.where(both == 0, np.nan, both))}


def features(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """All of the above that strategies read, in one sort of (symbol, date) and one sweep over it: frames of bars, of what derives from them, of that again; and forward returns of ``horizons``."""
    rows, close = forward_returns(in_order(bars), horizons), F.col("close")
    lags = sorted({1, *MOMENTUM, *(21 + p for p in (0, 63, 126, 252))})
    plain = {
        **{f"sma{n}": Frame("avg", "close", n) for n in (20, 50, 200)}, **{f"_lag{k}": Frame("lag", "close", back=k) for k in lags},
        "prior_high20": Frame("max", "high", 20, 1), "prior_low20": Frame("min", "low", 20, 1), "_high": Frame("lag", "high", back=1), "_low": Frame("lag", "low", back=1),
        "_usual": Frame("avg", "volume", 20, 1), "_dev": Frame("std", "close", 20), "_year": Frame("max", "close", 252, least=1), "_sixty": Frame("max", "close", 60, least=1),
    }
    averaged = {"atr": "tr", "gain": "gain", "loss": "loss", "_pdm": "pdm", "_mdm": "mdm"}
    averaged = {c: Frame("avg", x, 14) for c, x in averaged.items()} | {"vol20": Frame("std", "ret1", 20), "realized_vol": Frame("std", "ret1", 20, least=5)}
    rows = swept(rows, plain, _ranges_and_moves, averaged, _directions, adx=Frame("avg", "dx", 14))
    rows = trend_regime(rows).withColumnRenamed("_lag1", "prev_close").withColumns({
        **{f"mom{k}": close / F.col(f"_lag{k}") - 1 for k in MOMENTUM}, "mom_score": _score([f"_lag{21 + p}" for p in (0, 63, 126, 252)]), "volume_ratio": F.try_divide("volume", "_usual"),
        "bb_mid": F.col("sma20"), "bb_lower": F.col("sma20") - 2.0 * F.col("_dev"), "bb_upper": F.col("sma20") + 2.0 * F.col("_dev"),
        "near_high252": close / F.col("_year"), "drawdown60": (F.col("_sixty") - close) / F.col("_sixty"), "ret1": close / F.col("prev_close") - 1,
        "tr": _true_range(), "rsi": _strength(), "realized_vol": F.col("realized_vol") * math.sqrt(252),
    })
    rows = rows.drop("gain", "loss", "_pdm", "_mdm", "_high", "_low", "_usual", "_dev", "_year", "_sixty", *(f"_lag{k}" for k in lags))
    return _range_regime(rows)
