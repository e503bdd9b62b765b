import datetime as dt
import math

import numpy as np
import pandas as pd

from quantpanel.operators import folds, statistics
from quantpanel.plans import catalog

from .conftest import SF


def test_binomial_tail():
    assert abs(statistics.binomial_tail(6, 10) - 386 / 1024) < 1e-12 and statistics.binomial_tail(0, 5) == 1.0


def test_regression_recovers_betas():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(600), rng.normal(0, 0.01, (600, 2))])
    r = statistics.newey_west(x @ np.array([0.001, 1.5, -0.5]) + rng.normal(0, 0.001, 600), x)
    assert np.allclose(r["beta"], [0.001, 1.5, -0.5], atol=0.02) and r["r2"] > 0.9 and r["p"][1] < 0.01


def test_pairs_cointegrated_and_independent(spark):
    rng = np.random.default_rng(5)
    b, ou = np.cumsum(rng.normal(0, 0.01, 650)) + 5, np.zeros(650)
    for i in range(1, 650):
        ou[i] = 0.93 * ou[i - 1] + rng.normal(0, 0.01)
    walks = {"A": 0.8 * b + 1 + ou, "B": b, "C": np.cumsum(rng.normal(0, 0.01, 650)) + 4}
    days = pd.date_range("2020-01-01", periods=650).date
    bars = spark.createDataFrame(pd.concat([pd.DataFrame({"symbol": k, "date": days, "close": np.exp(v)}) for k, v in walks.items()]))
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "a string, b string")
    got = {r.b: r for r in statistics.validate_pairs(bars, pairs).collect()}
    assert got["B"].half_life and 3 < got["B"].half_life < 25 and "not cointegrated" not in got["B"].reasons
    assert not got["C"].valid and "not cointegrated" in got["C"].reasons


def test_hurst_of_a_walk():
    assert abs(statistics.hurst(np.cumsum(np.random.default_rng(3).normal(size=4000))) - 0.5) < 0.15


def test_backtest_by_hand():
    close = np.array([100.0] * 25 + [120.0] * 25)
    action = np.array(["BUY"] * 25 + ["SELL"] * 25)
    equity, done = folds.simulate(close, action, np.full(50, 0.95), np.full(50, "bull"), 0)
    assert done == [("BUY", 100.0), ("SELL", 120.0)]
    cash = 100_000 - 950 * 100 * 1.0012 + 950 * 120 * (1 - 0.0012)
    assert abs(equity[-1] - cash) < 1e-6 and folds.equity_metrics(equity, done)["win_rate"] == 1.0


def test_risk_budget_never_overspends(spark):
    rows = catalog.QUERIES["j04_risk_budget"](spark, SF).collect()
    assert rows and {r.outcome for r in rows} <= {"approved", "trimmed", "rejected"} and all(r.approved_qty >= 0 for r in rows)
    plans = spark.createDataFrame([("r", "A", "BUY", 1000.0, 10.0, 0.9, 1e9), ("r", "B", "BUY", 100.0, 10.0, 0.8, 1e9), ("r", "C", "SELL", 50.0, 10.0, 0.1, 1e9)], "run_id string, symbol string, action string, qty double, price double, confidence double, adv double")
    account = spark.createDataFrame([("r", 10_000.0, 5_000.0, 9_000.0)], "run_id string, netliq double, cash double, net_long double")
    got = {r.symbol: r for r in folds.risk_budget(plans, account).collect()}
    assert got["C"].outcome == "approved" and got["A"].outcome == "rejected" and (got["B"].outcome, got["B"].approved_qty) == ("approved", 100.0)


def test_paths_stop_at_level_three(spark):
    frame = spark.createDataFrame([("A", -0.05), ("A", -0.05)], "agent string, ret double")
    rows = statistics.path_bootstrap(frame, 10, 20).collect()
    assert len(rows) == 10 and all(r.breaker == 3 and r.max_drawdown < 0.12 for r in rows)


def test_helper_queries_run(spark):
    for name in ("d08_significance", "d37_factor_regressions", "d38_factor_verdicts", "i13_pair_validation", "j05_correlation_veto", "j06_backtests", "j07_walk_forward", "j09_path_bootstrap"):
        rows = catalog.QUERIES[name](spark, SF).collect()
        assert all(not isinstance(v, float) or not math.isinf(v) for r in rows for v in r), name


def test_resampling_queries_draw_as_often_as_the_reference(spark, monkeypatch):
    from quantpanel.operators import edge

    seen, walk = {}, statistics.path_bootstrap
    monkeypatch.setattr(statistics, "path_bootstrap", lambda r, paths, days, **k: seen.update(days=days) or walk(r, paths, days, **k))
    assert {r.n for r in catalog.QUERIES["j09_path_bootstrap"](spark, SF).collect()} == {10_000} and seen["days"] == 90
    intervals = edge.excess_intervals
    monkeypatch.setattr(edge, "excess_intervals", lambda s, r, draws=2000, **k: seen.update(draws=draws) or intervals(s, r, draws, **k))
    catalog.QUERIES["d09_excess_intervals"](spark, SF)
    assert seen["draws"] == 2000


def test_pairs_in_blocks(spark):
    """Any number of blocks gives the same rows; twins and a price of 1.00 that stands still are answered, pairs without a shared date have none."""
    rng, days = np.random.default_rng(4), [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(600)]
    closes = {s: np.exp(np.cumsum(rng.normal(0, 0.01, 300))) for s in ("A", "B", "C", "D")} | {"ONE": np.ones(300)}
    closes |= {"TWIN": closes["A"]}
    rows = [(s, days[k], float(c)) for s, v in closes.items() for k, c in enumerate(v)] + [("LATE", days[300 + k], 1.0 + k) for k in range(300)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    pairs = spark.createDataFrame([("A", "B"), ("A", "TWIN"), ("C", "ONE"), ("D", "C"), ("A", "LATE")], "a string, b string")
    groups = spark.createDataFrame([(s, "x" if s in "ABC" else "y") for s in closes if s != "D"], "symbol string, sector string")
    found = [sorted(map(str, statistics.validate_pairs(bars, pairs, **how).collect())) for how in ({}, {"block": 1}, {"block": 2, "groups": groups})]
    assert found[0] == found[1] == found[2] and len(found[0]) == 4
    got = {(r.a, r.b): r for r in statistics.validate_pairs(bars, pairs).collect()}
    assert got["A", "TWIN"].beta == 1 and got["A", "TWIN"].half_life is None and not got["A", "TWIN"].valid and not got["C", "ONE"].valid
