"""Rule strategies over a feature table: long signals (symbol, date, agent, action, confidence, target_weight, meta).

A strategy is a function from the feature table's columns to a struct (action, confidence, target_weight, error); ``signals`` evaluates
all of them on each row once and unfolds them, so the features are computed and read one time. A missing value
makes a comparison false. ``in_position`` is a column of the input (no position where absent). ``register_strategy`` adds one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.panel import true

C = F.col
ERROR_CHARS = 200


@dataclass(frozen=True)
class Strategy:
    name: str
    min_bars: int
    rule: Callable[[], Column]


_REGISTRY: dict[str, Strategy] = {}


def register_strategy(name: str, min_bars: int = 0) -> Callable:
    """``rule()`` returns ``decision(...)``; rows before ``min_bars`` give no signal."""

    def keep(rule: Callable[[], Column]) -> Callable[[], Column]:
        _REGISTRY[name] = Strategy(name, min_bars, rule)
        return rule

    return keep


def decision(action: Column | str, confidence: Column | float, weight: Column | float = 0.0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(action).alias("action"), lit(confidence).cast("double").alias("confidence"), lit(weight).cast("double").alias("target_weight"), F.lit(None).cast("string").alias("error"))


def failure(error: Column | str) -> Column:
    """A rule's answer that it has none: the error travels as data, and no signal comes of it."""
    none = lambda t: F.lit(None).cast(t)
    return F.struct(none("string").alias("action"), none("double").alias("confidence"), none("double").alias("target_weight"), F.substring(error if isinstance(error, Column) else F.lit(error), 1, ERROR_CHARS).alias("error"))


def _kinds(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(kind of each row, the first row of each kind); rows of a kind are equal to the bit. Other values than numbers, dates and texts make each row a kind of its own."""
    plain = all(c.dtype.kind != "O" or pd.api.types.infer_dtype(c, skipna=True) in ("string", "empty") for _, c in rows.items())
    if not plain or rows.columns.empty:
        return np.arange(len(rows)), np.arange(len(rows))
    keys = [c.to_numpy().view(f"i{c.dtype.itemsize}") if c.dtype.kind == "f" else c.to_numpy() for _, c in rows.items()]
    kinds = pd.DataFrame(dict(enumerate(keys))).groupby(list(range(len(keys))), sort=False, dropna=False).ngroup().to_numpy()
    return kinds, np.unique(kinds, return_index=True)[1]


def guarded(fn: Callable[[pd.DataFrame], pd.DataFrame], *columns: str) -> Column:
    """A rule in pandas: ``fn`` gets rows of ``columns`` and returns action, confidence and target_weight for each.

    Where it raises, equal rows are asked for once, and rows are halved until those that raise stand alone; they fail with the error's text, all others are answered.
    """

    def answers(rows: pd.DataFrame) -> list[np.ndarray]:
        said = fn(rows)
        found = [said[c].to_numpy() for c in ("action", "confidence", "target_weight")]
        if len(found[0]) != len(rows):
            raise ValueError(f"{len(found[0])} answers for {len(rows)} rows")
        return found

    def halved(rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        out = {"action": np.full(n, None, object), "confidence": np.full(n, np.nan), "target_weight": np.full(n, np.nan), "error": np.full(n, None, object)}
        waiting = [(0, n)]
        while waiting:
            low, high = waiting.pop()
            try:
                for name, values in zip(out, answers(rows.iloc[low:high])):
                    out[name][low:high] = values
            except Exception as e:  # a user's rule may raise anything
                if high - low > 1:
                    middle = (low + high) // 2
                    waiting += [(low, middle), (middle, high)]
                else:
                    out["error"][low] = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
        return pd.DataFrame(out)

    def run(*series: pd.Series) -> pd.DataFrame:
        rows = pd.concat(series, axis=1, keys=columns).reset_index(drop=True)
        try:
            action, confidence, weight = answers(rows) if len(rows) else (np.zeros(0),) * 3
            return pd.DataFrame({"action": action, "confidence": np.asarray(confidence, float), "target_weight": np.asarray(weight, float), "error": np.full(len(rows), None, object)})
        except Exception:  # a user's rule may raise anything
            kinds, first = _kinds(rows)
            return halved(rows.iloc[first]).iloc[kinds].reset_index(drop=True)

    run.__annotations__ = {"series": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "action string, confidence double, target_weight double, error string")(*columns)


def _count(*conditions: Column) -> Column:
    return sum((true(c).cast("int") for c in conditions), F.lit(0))


def _points(base: float, cap: float, *extra: tuple[float, Column]) -> Column:
    return F.least(F.lit(cap), sum((F.when(true(c), F.lit(p)).otherwise(F.lit(0.0)) for p, c in extra), F.lit(base)))


def _exit(reasons: Column, confidence: float, patient: bool = True) -> tuple[Column, Column]:
    """(whether to sell, confidence): one reason alone weighs less in a bull market."""
    sure = (reasons >= 2) | (C("regime") != "bull") if patient else F.lit(True)
    return C("in_position") & (reasons > 0), F.when(sure, confidence).otherwise(0.62)


@register_strategy("quality_trend", 260)
def quality_trend() -> Column:
    sell, sure = _exit(_count(C("close") < C("sma200"), C("vol20") > 0.05, C("drawdown60") > 0.12), 0.85)
    score = _count(C("close") > C("sma200"), C("vol20") <= 0.03, C("near_high252") >= 0.85)
    conf = F.element_at(F.array(*map(F.lit, (0.35, 0.55, 0.70, 0.90))), score + 1)
    held = F.when(score >= 2, decision("BUY", conf, 0.10)).otherwise(decision("HOLD", conf))
    return F.when(sell, decision("SELL", sure)).when(C("regime") == "bear", decision("HOLD", 0.7)).otherwise(held)


@register_strategy("multifactor", 210)
def multifactor() -> Column:
    sell, sure = _exit(_count(C("close") < C("sma200"), C("mom63") < -0.05, C("close") < C("prior_low20")), 0.88)
    trend = true((C("close") > C("sma200")) & (C("sma50") > C("sma200")))
    volume, breakout = true(C("volume_ratio") > 0.8), true(C("close") > C("prior_high20"))
    strong = true((C("mom63") > 0.05) & (C("mom21") > 0.01))
    conf = _points(0.65, 0.95, (0.10, breakout), (0.10, C("mom63") > 0.08), (0.05, volume), (0.05, C("atr_pct") < 0.015))
    rest = F.when(trend, decision("HOLD", 0.3)).otherwise(decision("HOLD", 0.1))
    return F.when(sell, decision("SELL", sure)).when(C("regime") == "bear", decision("HOLD", 0.2)).when(trend & volume & (breakout | strong), decision("BUY", conf, 0.12)).otherwise(rest)


@register_strategy("mean_reversion", 50)
def mean_reversion() -> Column:
    """Reads market_drawdown where there is one: buying stops beyond 20 %."""
    sell, sure = _exit(_count(C("rsi") > 65, C("close") >= C("sma20")), 0.82, patient=False)
    volume = true(C("volume_ratio") > 1.2)
    limit = F.when(C("regime") == "bear", 30).otherwise(35)
    buy = true((C("rsi") < limit) & (C("close") < C("bb_lower"))) & volume
    conf = _points(0.65, 0.92, (0.10, C("rsi") < 25), (0.10, C("close") < C("bb_lower") * 0.99), (0.05, volume))
    return F.when(sell, decision("SELL", sure)).when(true(C("market_drawdown") > 0.20), decision("HOLD", 0.0)).when(buy, decision("BUY", conf, 0.08)).otherwise(decision("HOLD", 0.3))


@register_strategy("trend_following", 210)
def trend_following() -> Column:
    up = true((C("close") > C("sma20")) & (C("sma20") > C("sma50")) & (C("sma50") > C("sma200")))
    down = true((C("close") < C("sma20")) & (C("sma20") < C("sma50")) & (C("sma50") < C("sma200")))
    strong, mom20, mom50 = true(C("adx") > 25), F.coalesce("mom20", F.lit(0.0)), F.coalesce("mom50", F.lit(0.0))
    sell, sure = _exit(_count(down, ~strong & (mom20 < -0.03), (C("close") < C("sma50")) & (mom50 < -0.05)), 0.83)
    conf = _points(0.65, 0.92, (0.10, C("adx") > 30), (0.10, mom50 > 0.05), (0.05, mom20 > 0.03))
    return F.when(sell, decision("SELL", sure)).when(C("regime") == "bear", decision("HOLD", 0.2)).when(up & strong & (mom20 > 0.01), decision("BUY", conf, 0.10)).otherwise(decision("HOLD", 0.3))


@register_strategy("long_short_trend", 210)
def long_short_trend() -> Column:
    """Momentum signs agree with the side of SMA200 and ADX is at least 20 (a held side stays down to 15); weight by target volatility, signed."""
    up = true((C("mom63") > 0) & (C("mom126") > 0) & (C("close") > C("sma200")))
    down = true((C("mom63") < 0) & (C("mom126") < 0) & (C("close") < C("sma200")))
    strong = true(C("adx") >= 20)
    weight = F.least(F.try_divide(F.lit(0.10), C("realized_vol")), F.lit(0.15))
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (C("adx") - 20) / 30))
    flat = F.when(C("in_position") & true(C("adx") < 15), decision("SELL", 0.7)).otherwise(decision("HOLD", 0.3))
    known = weight.isNotNull()
    return F.when(strong & up & known, decision("BUY", conf, weight)).when(strong & down & known, decision("SELL", conf, -weight)).otherwise(flat)


def _ready(features: DataFrame) -> DataFrame:
    rows = features
    for column, value in (("in_position", F.lit(False)), ("market_drawdown", F.lit(None).cast("double"))):
        if column not in rows.columns:
            rows = rows.withColumn(column, value)
    return rows


def decided(features: DataFrame, names: list[str | Strategy] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, date, keep.., said): what each strategy says of a row with enough history, a signal or an error, in an array.

    A rule that cannot be planned, one that says ``failure(..)`` and a ``guarded`` one that raises all end in an error and leave the other
    strategies alone. A native rule keeps to the ``try_`` forms where a value may not be computable.
    """
    rows = features
    for column, value in (("in_position", F.lit(False)), ("market_drawdown", F.lit(None).cast("double"))):
        if column not in rows.columns:
            rows = rows.withColumn(column, value)
    chosen = [_REGISTRY[n] if isinstance(n, str) else n for n in (names or list(_REGISTRY))]

    def planned(check: bool) -> DataFrame:
        each = []
        for k, s in enumerate(chosen):
            try:
                said = s.rule()
                if check:
                    rows.select(said).schema
            except Exception as e:  # a user's rule may raise anything
                said = failure(f"{type(e).__name__}: {e}".split("\n")[0])
            each.append(F.struct(F.lit(k).alias("agent_ord"), F.lit(s.name).alias("agent"), F.when(C("n_bars") >= s.min_bars, F.coalesce(said, failure("None: the rule gave nothing"))).alias("d")))
        return rows.select("symbol", "date", *keep, F.array(*each).alias("said"))

    try:
        return planned(False)
    except AnalysisException:
        return planned(True)


def names() -> list[str]:
    """All registered strategies, in the order of ``decided``."""
    return list(_REGISTRY)


def answered(k: int) -> Column:
    """Whether the ``k``-th strategy of a row of ``decided`` gave a signal."""
    d = C("said")[k]["d"]
    return d["action"].isNotNull() & d["error"].isNull()


def unfolded(decided_rows: DataFrame) -> DataFrame:
    """A row per strategy that had enough history: action, confidence, target_weight, or an error and nothing else."""
    keep = [c for c in decided_rows.columns if c != "said"]
    out = decided_rows.select(*keep, F.inline("said")).where("d IS NOT NULL")
    error = F.coalesce("d.error", F.when(C("d.action").isNull(), "None: the rule gave no action"))
    return out.select(*keep, "agent_ord", "agent", "d.action", "d.confidence", "d.target_weight", error.alias("error"))


def signals(features: DataFrame, names: list[str | Strategy] | None = None) -> DataFrame:
    """Long signals of the named (default: all registered) strategies. A symbol without history has no row for a strategy, nor has a row on which its rule fails."""
    return unfolded(decided(features, names)).where("error IS NULL").drop("error")


def isolated_signals(features: DataFrame, names: list[str | Strategy] | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, failures (symbol, date, agent, error)): a failing rule is absent from the signals, not a HOLD."""
    said = unfolded(decided(features, names))
    return said.where("error IS NULL").drop("error"), said.where("error IS NOT NULL").select("symbol", "date", "agent", "error")


def volatility_index_signal(rows: DataFrame) -> DataFrame:
    """Extremes of a volatility index (columns close, vix_z, vix_mom5, vix_ratio, held): a held name is sold on a spike or on complacency, another one bought in fear."""
    spike = C("held") & ((C("vix_mom5") > 0.20) | (C("vix_ratio") > 1.40))
    calm = C("held") & (C("close") < 15) & (C("vix_z") < -1.5)
    extreme = ~C("held") & (C("close") > 35) & (C("vix_z") > 1.5)
    fear = ~C("held") & (C("close") > 25) & (C("vix_z") > 0.8) & (C("vix_mom5") < 0.05)
    pick = lambda a, b, c, d, e: F.when(spike, a).when(calm, b).when(extreme, c).when(fear, d).otherwise(e)
    afraid = F.least(F.lit(0.82), 0.60 + (C("close") - 25) * 0.01)
    return rows.withColumns({"action": pick("SELL", "SELL", "BUY", "BUY", "HOLD"), "confidence": pick(0.85, 0.70, 0.88, afraid, 0.3), "target_weight": pick(0.0, 0.0, 0.10, 0.08, 0.0)})


def macro_points(rows: DataFrame) -> DataFrame:
    """Risk-on and risk-off points of four indicators (yield_curve, hy_spread, vix, fed_trend); a null skips."""
    curve, spread, vix, fed = (C(c) for c in ("yield_curve", "hy_spread", "vix", "fed_trend"))
    points = lambda *steps: F.coalesce(F.when(steps[0][0], steps[0][1]) if len(steps) == 1 else F.when(steps[0][0], steps[0][1]).when(steps[1][0], steps[1][1]), F.lit(0))
    off = points((curve < -0.25, 2), (curve < 0, 1)) + points((spread > 600, 2), (spread > 450, 1)) + points((vix > 30, 2), (vix > 23, 1)) + points((fed > 0.75, 1))
    on = points((curve > 1.0, 2), (curve > 0.5, 1)) + points((spread < 300, 2), (spread < 380, 1)) + points((vix < 15, 1)) + points((fed < -0.50, 1))
    return rows.withColumns({"risk_on": on, "risk_off": off})


INDICATORS = ("yield_curve", "hy_spread", "vix", "fed_trend")
FUNDS = ("equity", "gold", "bonds")


def fund_points(dates: DataFrame, funds: DataFrame, period: int = 63) -> DataFrame:
    """dates (date) with risk-on and risk-off points of three funds' momentum; funds (role of ``FUNDS``, date, close).

    A fund's momentum is over its last ``period`` closes, 0 where it has no more than that; a date without a close takes the fund's last. The
    calendar, a row a day, is filled in one task.
    """
    own = W.partitionBy("role").orderBy("date")
    known = funds.where("close IS NOT NULL")
    mom = F.when(F.row_number().over(own) > period, C("close") / F.lag("close", period - 1).over(own) - 1).otherwise(0.0)
    wide = known.withColumn("mom", mom).groupBy("date").pivot("role", list(FUNDS)).agg(F.first("mom"))
    days = dates.select("date", F.lit(True).alias("wanted")).distinct().join(wide, "date", "full")
    upto = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    days = days.withColumns({f: F.coalesce(F.last(f, ignorenulls=True).over(upto), F.lit(0.0)) for f in FUNDS}).where("wanted")
    equity, gold, bonds = (C(f) for f in FUNDS)
    on = F.when(equity > 0.05, 2).otherwise(0) + F.when(gold < 0, 1).otherwise(0) + F.when(bonds < -0.03, 1).otherwise(0)
    off = F.when(equity < -0.05, 2).otherwise(0) + F.when(gold > 0.05, 1).otherwise(0) + F.when(bonds > 0.03, 1).otherwise(0)
    return days.select("date", on.alias("risk_on"), off.alias("risk_off"))


def macro_or_fund_points(rows: DataFrame, funds: DataFrame, period: int = 63) -> DataFrame:
    """``macro_points`` of rows (date, indicators); a row without any indicator takes the points of the funds."""
    proxy = fund_points(rows, funds, period).withColumnsRenamed({"risk_on": "_on", "risk_off": "_off"})
    none = F.coalesce(*(C(c).cast("string") for c in INDICATORS)).isNull()
    out = macro_points(rows).join(proxy, "date")
    return out.withColumns({"risk_on": F.when(none, C("_on")).otherwise(C("risk_on")), "risk_off": F.when(none, C("_off")).otherwise(C("risk_off")), "source": F.when(none, "funds").otherwise("indicators")}).drop("_on", "_off")


def macro_signal(rows: DataFrame, least: int = 4, confirm: float = 0.02) -> DataFrame:
    """rows (risk_on, risk_off, mom63, regime, held): the ticker's own momentum must confirm the points."""
    sell = C("held") & (C("risk_off") >= least) & (C("mom63") < -confirm)
    buy = (C("risk_on") >= least) & (C("regime") != "bear") & (C("mom63") > confirm)
    pick = lambda a, b, c: F.when(sell, a).when(buy, b).otherwise(c)
    sure = F.least(F.lit(0.85), 0.60 + F.when(C("risk_on") >= least + 2, 0.10).otherwise(0.0))
    return rows.withColumns({"action": pick("SELL", "BUY", "HOLD"), "confidence": pick(0.80, sure, 0.4), "target_weight": pick(0.0, 0.05, 0.0)})


def scored_news_signal(scored: DataFrame, least: float = 0.55, weight: float = 0.10) -> DataFrame:
    """An already scored table (action, confidence): below ``least`` is HOLD; BUY carries the weight."""
    action = F.when(C("confidence") < least, "HOLD").otherwise(C("action"))
    return scored.withColumn("action", action).withColumn("target_weight", F.when(C("action") == "BUY", weight).otherwise(0.0))
