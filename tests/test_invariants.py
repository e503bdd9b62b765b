"""Statistical and causal invariants, folds against plain Python, small hand-made frames."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantpanel.operators import edge, features, folds, pit, quality, strategies, trades
from quantpanel.plans import catalog
from quantpanel.sources.fixtures import view

from .conftest import SF


def _bars(spark, closes, symbol="A"):
    day = dt.date(2022, 1, 3)
    rows = [(symbol, day + dt.timedelta(days=i), c * 0.995, c * 1.01, c * 0.99, float(c), 1e6) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_no_look_ahead(spark):
    bars = view(spark, SF, "bars").where("symbol IN ('S1', 'S2')")
    day = bars.agg(F.percentile_approx("date", 0.6)).first()[0]
    cut = lambda b: strategies.signals(features.features(b)).where(F.col("date") <= F.lit(day))
    whole, part = cut(bars), cut(bars.where(F.col("date") <= F.lit(day)))
    assert whole.exceptAll(part).count() == 0 and part.exceptAll(whole).count() == 0


def test_failing_strategy_is_absent_not_hold(spark):
    out = strategies.signals(features.features(_bars(spark, [100.0] * 60)))
    assert {r.agent for r in out.select("agent").distinct().collect()} == {"mean_reversion"}


def test_quality(spark):
    spiky = [100 * (5 if i % 10 == 5 else 1) for i in range(280)]
    riser = [100 * 1.01**i for i in range(700)]
    jump = [1.0] * 20 + [2.0] + [1100.0] * 20
    rows = _bars(spark, spiky, "spiky").union(_bars(spark, riser, "riser")).union(_bars(spark, jump, "jump")).union(_bars(spark, [1.0] * 5, "short"))
    got = {r.symbol: r.reason for r in quality.assess(rows).collect()}
    assert got == {"spiky": "jumps", "riser": None, "jump": "range", "short": "short"}
    with pytest.raises(ValueError):
        quality.normalize_bars(rows.drop("high"))


def test_rsi_without_loss(spark):
    rows = _bars(spark, [100.0 + i for i in range(30)])
    assert features.rsi(rows).orderBy(F.desc("date")).first().rsi == 0.0
    assert features.rsi(rows, classic=True).orderBy(F.desc("date")).first().rsi == 100.0


def test_round_trips_equal_a_queue(spark):
    rng = random.Random(3)
    rows = [("p", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "A", rng.choice(["BUY", "SELL"]), 100.0 + i, i) for i in range(200)]
    ex = spark.createDataFrame([(p, t, s, side, 1.0, px, px, 0.0 if o % 9 == 0 else px, o) for p, t, s, side, px, o in rows], "plan_id string, timestamp timestamp, symbol string, side string, qty double, limit_price double, last_price double, avg_fill_price double, ordinal long")
    won = spark.createDataFrame([("p", "A", "X", "bull")], "plan_id string, symbol string, agent string, regime string")
    queue, want = [], []
    for _, _, _, side, px, o in rows:
        if o % 9 == 0:
            continue
        if side == "BUY":
            queue.append(px)
        elif queue:
            want.append((queue.pop(0), px))
    got = sorted((r.entry_price, r.exit_price) for r in trades.round_trips(ex, won).collect())
    assert got == sorted(want)


def test_restated_balance_sheet(spark):
    d = dt.date
    facts = spark.createDataFrame([("X", "assets", 0, d(2009, 6, 30), None, d(2009, 7, 22), 39.572e9, 1), ("X", "assets", 0, d(2009, 6, 30), None, d(2010, 1, 25), 36.171e9, 2)], "ticker string, metric string, tag_rank int, period_end date, period_start date, filed date, value double, ordinal long")
    assert [r.value for r in pit.as_known(facts, "2009-11-01").collect()] == [39.572e9]
    assert [r.value for r in pit.as_known(facts, "2010-06-01").collect()] == [36.171e9]


def test_block_starts_spread_over_the_calendar():
    starts = edge.drawn(np.arange(40)[:, None], np.arange(20)[None, :], 1) % 97
    assert starts.shape == (40, 20) and starts.min() >= 0 and len(np.unique(starts)) > 80
    again = edge.drawn(np.arange(40)[:, None], np.arange(20)[None, :], 2) % 97
    assert (starts != again).mean() > 0.9


def test_interval_brackets_the_excess(spark):
    out = catalog.QUERIES["d09_excess_intervals"](spark, SF).where("n_dates >= 60").collect()
    assert out and all(r.low <= r.excess <= r.high for r in out)


def test_breaker_is_sticky(spark):
    eq = spark.createDataFrame([("a", i, v) for i, v in enumerate([100.0, 95.0, 90.0, 99.0, 100.0])], "account string, date int, netliq double")
    assert [r.level for r in trades.drawdown_breaker(eq).orderBy("date").collect()] == [0, 1, 3, 3, 3]


def test_backtests_of_signals_that_carry_their_closes(spark):
    rows = features.features(_bars(spark, [100.0 + 10 * ((k * 7) % 13) for k in range(300)]))
    plain = strategies.signals(rows)
    own = strategies.unfolded(strategies.decided(rows, keep=("close", "regime"))).where("error IS NULL").drop("error")
    got = [sorted(map(str, folds.backtests(*how).collect())) for how in ((plain, rows), (own,))]
    assert got[0] == got[1] and len(got[0]) == 5
