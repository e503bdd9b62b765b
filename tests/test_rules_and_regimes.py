"""Regime clusters, interval joins, pair states, risk budgets, failure isolation, resampling and the equivalence audit on hand-made frames."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantpanel.functions import asof
from quantpanel.operators import audit, edge, features, folds, logs, pit, regimes, risk, statistics, strategies
from quantpanel.plans import catalog
from quantpanel.sources.fixtures import view

from .conftest import SF

DAY = dt.date(2020, 1, 1)


def _day(k):
    return DAY + dt.timedelta(days=int(k))


# Regimes


def _planted(spark, n=400):
    """Four well separated clouds: (mom_30d, vol_21d) decide the names."""
    rng = np.random.default_rng(4)
    centres = {"bear": (-0.10, 0.50), "sideways": (-0.01, 0.10), "bull_quiet": (0.06, 0.12), "bull_volatile": (0.12, 0.45)}
    rows = []
    for j, (name, (mom, vol)) in enumerate(centres.items()):
        x = rng.normal(0, 1, (n, 6)) * 0.01
        x += np.array([vol, vol, mom / 3, mom, mom, vol / 20])
        rows += [(name, _day(j * n + k), *map(float, r)) for k, r in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, date date, " + ", ".join(f"{c} double" for c in regimes.FEATURES))


def test_regimes_find_planted_clouds(spark):
    matrix = _planted(spark)
    model = regimes.fit_regimes(matrix)
    got = regimes.regime_posteriors(model, matrix).toPandas()
    assert (got.gmm_regime == got.symbol).mean() > 0.99 and set(model.names) == set(regimes.THREE_WAY)
    p = got[[f"p_{n}" for n in regimes.THREE_WAY]].to_numpy()
    assert np.allclose(p.sum(1), 1, atol=1e-9)
    assert np.allclose(got.position_scale, np.clip(p @ np.array([regimes.POSITION[n] for n in regimes.THREE_WAY]), 0.2, 1))
    # posteriors again from the fitted means and covariances
    x = matrix.select(*regimes.FEATURES).toPandas().to_numpy()
    z, mixture = (x - x.mean(0)) / x.std(0, ddof=1), model.stages.stages[2]
    like = []
    for w, g in zip(mixture.weights, mixture.gaussians):
        cov, d = g.cov.toArray(), z - g.mean.toArray()
        like.append(np.log(w) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1] + 6 * np.log(2 * np.pi)))
    like = np.array(like).T
    own = np.exp(like - np.logaddexp.reduce(like, axis=1, keepdims=True))
    assert np.allclose(own, got[[f"p_{n}" for n in model.names]].to_numpy(), atol=1e-6)


def test_regime_fit_is_that_of_spark_in_fewer_passes(spark):
    from pyspark.ml.clustering import GaussianMixture

    x = np.random.default_rng(7).normal(size=(3000, 6)) * np.array([1, 2, 1, 3, 1, 0.1])
    matrix = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in regimes.FEATURES)).persist()
    sc = spark.sparkContext
    sc.setJobGroup("regime-fit", "")
    model = regimes.fit_regimes(matrix, first_iter=4, max_iter=40, tol=1e-6)
    jobs = len(sc.statusTracker().getJobIdsForGroup("regime-fit"))
    sc.setJobGroup("", "")
    scaled = model.stages.stages[1].transform(model.stages.stages[0].transform(matrix)).select("scaled").persist()
    fits = {k: GaussianMixture(k=4, featuresCol="scaled", seed=k, maxIter=4, tol=1e-6).fit(scaled) for k in range(42, 46)}
    want = GaussianMixture(k=4, featuresCol="scaled", seed=max(fits, key=lambda k: fits[k].summary.logLikelihood), maxIter=40, tol=1e-6).fit(scaled)
    assert np.isclose(model.log_likelihood, want.summary.logLikelihood, rtol=1e-10)
    assert np.allclose(model.stages.stages[2].weights, want.weights, atol=1e-8)
    for own, g in zip(model.stages.stages[2].gaussians, want.gaussians):
        assert np.allclose(own.mean.toArray(), g.mean.toArray(), atol=1e-7) and np.allclose(own.cov.toArray(), g.cov.toArray(), atol=1e-7)
    # one job a pass of all starts together; a run of its own for each start, and the best again from its begin, took 4 * 4 + 40 beside those of the starts
    assert want.summary.numIter == 40 and jobs < 4 * 4 + 40 + 12
    matrix.unpersist()
    scaled.unpersist()


def test_regime_series_fills_forward(spark):
    bars = spark.createDataFrame([("A", _day(k)) for k in range(5)] + [("B", _day(2))], "symbol string, date date")
    cols = "p_bull_quiet double, p_bull_volatile double, p_bear double, p_sideways double"
    marks = spark.createDataFrame([("A", _day(1), "bear", 0.2, 0.0, 0.0, 1.0, 0.0), ("A", _day(3), "sideways", 0.5, 0.0, 0.0, 0.0, 1.0)], f"symbol string, date date, gmm_regime string, position_scale double, {cols}")
    got = {(r.symbol, r.date): r.regime for r in regimes.regime_series(bars, marks).collect()}
    assert [got["A", _day(k)] for k in range(5)] == [None, "bear", "bear", "choppy", "choppy"] and got["B", _day(2)] is None


def test_regime_query(spark):
    got = catalog.QUERIES["i15_regime_clusters"](spark, SF).toPandas()
    bars = view(spark, SF, "bars").groupBy("symbol").count().toPandas().set_index("symbol")["count"]
    assert len(got) == bars.sum() and set(got.regime.dropna()) <= {"bull", "bear", "choppy"}
    assert got.groupby("symbol").regime.apply(lambda r: r.isna().sum()).le(30).all()
    known = got.dropna()
    assert np.allclose(known[[c for c in known if c.startswith("p_")]].sum(axis=1), 1, atol=1e-5)


# Interval joins


def test_interval_joins_are_linear(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n_snaps, n_bars = 40, 3000
    snaps = [_day(k) for k in sorted(rng.choice(n_bars, n_snaps, replace=False))]
    members = [(d, s) for d in snaps for s in "ABC" if rng.random() < 0.6]
    bars = [(s, _day(k), float(k)) for s in "ABC" for k in range(n_bars)]
    snaps = sorted({d for d, _ in members})
    got = {(r.symbol, r.date, r.as_of) for r in pit.members_on(spark.createDataFrame(bars, "symbol string, date date, close double"), spark.createDataFrame(members + members[:3], "as_of date, ticker string")).collect()}
    want, held = set(), set(members)
    for s, d, _ in bars:
        past = [x for x in snaps if x <= d]
        if past and (past[-1], s) in held:
            want.add((s, d, past[-1]))
    assert got == want
    # candidates of the binned join: those of the result and of the edge bins alone
    spans = spark.createDataFrame([(k, _day(7 * k), _day(7 * k + 300)) for k in range(200)] + [(900, _day(5), _day(5)), (901, _day(5), None)], "k int, lo date, hi date")
    points = spark.createDataFrame([(_day(5 * j),) for j in range(400)], "at date")
    inside = asof.points_inside(spans, points, "lo", "hi", "at")
    assert sorted((r.k, r.at) for r in inside.collect()) == sorted((k, _day(5 * j)) for k in range(200) for j in range(400) if 7 * k <= 5 * j < 7 * k + 300)
    bins = spans.where("hi > lo").withColumn("b", F.explode(F.sequence(F.floor(F.unix_date("lo") / 32), F.floor(F.unix_date(F.date_sub("hi", 1)) / 32))))
    candidates = bins.join(points.withColumn("b", F.floor(F.unix_date("at") / 32)), "b").count()
    assert inside.count() <= candidates <= inside.count() + 200 * 2 * 7 < 200 * 400 / 3


def test_accruals_and_blackout_by_hand(spark):
    panel = spark.createDataFrame([("A", _day(0), 0.1, _day(10)), ("A", _day(90), 0.2, _day(100)), ("A", _day(60), 0.9, _day(120)), ("B", _day(0), 0.5, _day(5))], "ticker string, period_end date, accruals double, available date")
    dates = spark.createDataFrame([(_day(k),) for k in (4, 10, 99, 100, 130, 730, 731, 820, 821)], "date date")
    got = sorted((r.ticker, (r.date - DAY).days, r.accruals) for r in pit.accruals_on(panel, dates).collect())
    assert got == sorted([("A", 10, 0.1), ("A", 99, 0.1)] + [("A", k, 0.2) for k in (100, 130, 730, 731, 820)] + [("B", k, 0.5) for k in (10, 99, 100, 130, 730)])
    buys = spark.createDataFrame([("A", _day(k)) for k in range(14)], "symbol string, date date")  # 2020-01-01 is a Wednesday
    earnings = spark.createDataFrame([("A", dt.date(2020, 1, 8)), ("A", None), ("B", dt.date(2020, 1, 2))], "symbol string, earnings_date date")
    assert [r.date.day for r in risk.earnings_blackout(buys, earnings).orderBy("date").collect()] == [3, 4, 5, 6, 7, 8]


def test_places_over_ranges(spark):
    from quantpanel.functions.ranks import numbered

    rng = np.random.default_rng(3)
    rows = [(int(x), k) for k, x in enumerate(rng.integers(0, 40, 2000))]
    got = numbered(spark.createDataFrame(rows, "v int, k int").repartition(7), [F.desc("v"), "k"]).collect()
    assert [(r.v, r.k) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[0], r[1])) and {r.place for r in got} == set(range(1, 2001))


# Correlations


def test_blocks_give_every_pair(spark):
    rng = np.random.default_rng(6)
    names, common = [f"S{k}" for k in range(17)], rng.normal(0, 0.01, 90)
    closes = {s: 100 * np.cumprod(1 + 0.5 * common + rng.normal(0, 0.01, 90)) for s in names}
    rows = [(s, _day(k), float(c)) for s in names for k, c in enumerate(closes[s]) if s == "S0" or rng.random() < 0.8] + [("FLAT", _day(k), 5.0) for k in range(90)] + [("FEW", _day(k), 5.0 + k) for k in range(4)]
    frame = spark.createDataFrame(rows, "symbol string, date date, close double")
    returns = pd.DataFrame(rows, columns=["s", "d", "c"]).pivot(index="d", columns="s", values="c")
    returns = pd.DataFrame({s: returns[s].dropna().tail(61).pct_change() for s in returns}).sort_index()
    want = {}
    for a, b in itertools.combinations(sorted(returns), 2):
        both = returns[[a, b]].dropna()
        if len(both) >= 20:
            want[a, b] = (len(both), both[a].corr(both[b]) if "FLAT" not in (a, b) else None)
    for got in (risk.correlations(frame), risk.correlations(frame, blocks=3), risk.pair_correlations(frame, spark.createDataFrame([(b, a) for a, b in want], "a string, b string"))):
        got = {(r.a, r.b): (r.n, r.corr) for r in got.collect()}
        assert set(got) == set(want)
        for k, (n, c) in want.items():
            assert got[k][0] == n and (got[k][1] is None if c is None else abs(got[k][1] - c) < 1e-9)


# Pairs


def _walk(zs, gone):
    """One pair, row by row: (held, action, side shown)."""
    side, out = None, []
    for z, g in zip(zs, gone):
        held = side is not None
        if held:
            action = "BREAK" if g else "STOP" if abs(z) > 3.5 else "EXIT" if abs(z) < 0.5 else "HOLD"
            out.append((held, action, side))
            side = side if action == "HOLD" else None
        else:
            if not g and abs(z) > 2:
                side = "SELL" if z > 0 else "BUY"
            out.append((held, "ENTER" if side else "HOLD", side))
    return out


def test_pair_states(spark, monkeypatch):
    rng = np.random.default_rng(8)
    hand = [-2.1, -1.0, -0.3, 1.2, 2.7, 3.0, 3.6, 3.7, 3.8, 0.4, -4.0, -4.0, 4.0, 2.5, -2.5, 0.1, 2.0, -0.5, 2.01]
    series = {("A", "B"): hand, ("C", "D"): (rng.normal(0, 2.2, 400)).tolist(), ("E", "F"): (rng.normal(0, 2.2, 300)).tolist()}
    rows = [(a, b, _day(k), z, k % 3) for (a, b), zs in series.items() for k, z in enumerate(zs)]
    frame = spark.createDataFrame([(a, b, d, z) for a, b, d, z, _ in rows], "a string, b string, date date, z double")
    monkeypatch.setattr(risk, "spread_zscore", lambda bars, pairs, n: frame.join(pairs, ["a", "b"]))
    pairs = spark.createDataFrame([("A", "B", 1.0, 0, None), ("C", "D", 1.0, 1, None), ("E", "F", 1.0, 0, _day(150))], "a string, b string, beta double, extra int, active_until date")
    got = risk.pair_signals(None, pairs).toPandas().sort_values(["a", "date"])
    for (a, _), zs in series.items():
        own = got[got.a == a]
        want = _walk(zs, [a == "E" and k > 150 for k in range(len(zs))])
        assert [(h, x, None if pd.isna(s) else s) for h, x, s in zip(own.held, own.action, own.side_a)] == want
    first = got[got.a == "A"].iloc[0]
    assert (first.action, first.side_a, first.side_b, first.confidence) == ("ENTER", "BUY", "SELL", 0.61)
    assert set(got[got.a == "C"].confidence[got[got.a == "C"].action == "ENTER"].round(3)) <= {round(x, 3) for x in np.arange(0.63, 0.931, 0.001)}


def test_sketches_recall_valid_pairs(spark):
    """Twenty cointegrated pairs among independent walks: nearly all are candidates, few others are."""
    rng = np.random.default_rng(12)
    closes = {}
    for k in range(20):
        b = np.cumsum(rng.normal(0, 0.01, 504))
        noise = np.zeros(504)
        for i in range(1, 504):
            noise[i] = 0.9 * noise[i - 1] + rng.normal(0, 0.004)
        closes[f"A{k}"], closes[f"B{k}"] = rng.uniform(0.7, 1.3) * b + noise, b
    days = [_day(k) for k in range(504)]
    bars = spark.createDataFrame(pd.concat([pd.DataFrame({"symbol": s, "date": days, "close": np.exp(v)}) for s, v in closes.items()] + [pd.DataFrame({"symbol": "FLAT", "date": days, "close": 1.0})]))
    groups = spark.createDataFrame([(s, "x") for s in [*closes, "FLAT"]], "symbol string, sector string")
    found = {(r.a, r.b) for r in statistics.sketch_candidates(bars, groups).collect()}
    every = list(itertools.combinations(sorted(closes), 2))
    exact = statistics.validate_pairs(bars, spark.createDataFrame([p for p in every if p[0][1:] == p[1][1:]], "a string, b string")).toPandas()
    good = {(r.a, r.b) for r in exact.itertuples() if "not cointegrated" not in r.reasons}
    assert len(good) >= 15 and len(good & found) >= 0.9 * len(good) and len(found) < 0.6 * len(every) and not any("FLAT" in p for p in found)
    ready = statistics.tradable(statistics.validate_pairs(bars, spark.createDataFrame(list(found), "a string, b string")))
    assert ready.columns == ["a", "b", "beta", "extra"]


# Risk budget

PLAN = "run_id string, symbol string, strategy string, action string, qty double, price double, confidence double, adv double, current_qty double"
ACCOUNT = "run_id string, netliq double, cash double, net_long double, regime string, sell_only boolean"


def _budget(spark, plans, limits=None, net_long=0.0, cash=100_000.0, regime=None, sell_only=False):
    rows = [("r", s, kind, action, notional / 100, 100.0, conf, adv, held) for s, kind, action, notional, conf, adv, held in plans]
    got = folds.risk_budget(spark.createDataFrame(rows, PLAN), spark.createDataFrame([("r", 100_000.0, cash, net_long, regime, sell_only)], ACCOUNT), limits or folds.Limits(net_long=0.40))
    return {r.symbol: (r.outcome, r.approved_qty, r.reason) for r in got.collect()}


def test_budgets_apart(spark):
    d, m, t = "directional", "market_neutral", "cta_trend"
    wide = folds.Limits(net_long=0.40, name=0.50, cash=0.10)
    got = _budget(spark, [("DIR", d, "BUY", 35_000, 0.9, 0.0, 0.0), ("L", m, "BUY", 10_000, 0.8, 0.0, 0.0), ("S", m, "BUY", 10_000, 0.7, 0.0, 0.0)], wide)
    assert {k: v[0] for k, v in got.items()} == {"DIR": "approved", "L": "approved", "S": "approved"}
    got = _budget(spark, [("L", m, "BUY", 16_000, 0.8, 0.0, 0.0), ("S", m, "BUY", 16_000, 0.7, 0.0, 0.0)], wide)
    assert got["L"][0] == "approved" and got["S"] == ("rejected", 0.0, "market_neutral")
    got = _budget(spark, [("X", t, "SELL", 40_000, 0.8, 0.0, 0.0), ("Y", t, "BUY", 30_000, 0.7, 0.0, 0.0), ("Z", t, "BUY", 5_000, 0.1, 0.0, -50.0)])
    assert got["X"][0] == "approved" and got["Y"] == ("rejected", 0.0, "cta_trend") and got["Z"][0] == "approved"
    got = _budget(spark, [("A", d, "BUY", 1_000, 0.8, 0.0, 0.0), ("B", m, "BUY", 1_000, 0.8, 0.0, 0.0), ("C", t, "BUY", 1_000, 0.8, 0.0, 0.0), ("D", m, "SELL", 8_000, 0.8, 0.0, 66.0), ("E", d, "HOLD", 0, 0.1, 0.0, 5.0)], sell_only=True)
    assert [got[k][0] for k in "ABCDE"] == ["rejected"] * 3 + ["approved"] * 2


def test_directional_rooms(spark):
    d = "directional"
    assert _budget(spark, [("A", d, "BUY", 25_000, 0.9, 0.0, 0.0)])["A"] == ("trimmed", 200.0, "name")
    assert _budget(spark, [("A", d, "BUY", 20_000, 0.9, 0.0, 0.0)])["A"][0] == "approved"
    assert _budget(spark, [("A", d, "BUY", 20_000, 0.9, 0.0, 0.0)], net_long=30_000.0)["A"] == ("trimmed", 100.0, "net long")
    assert _budget(spark, [("A", d, "BUY", 20_000, 0.9, 0.0, 0.0)], net_long=36_000.0)["A"] == ("rejected", 0.0, "net long")  # under a quarter
    assert _budget(spark, [("A", d, "BUY", 20_000, 0.9, 0.0, 0.0), ("H", d, "HOLD", 0, 0.0, 0.0, 300.0)])["A"] == ("trimmed", 100.0, "net long")
    assert _budget(spark, [("A", d, "BUY", 20_000, 0.9, 0.0, 0.0)], cash=40_000.0)["A"] == ("trimmed", 100.0, "cash")
    assert _budget(spark, [("A", d, "BUY", 20_000, 0.9, 0.0, 0.0), ("S", d, "SELL", 10_000, 0.1, 0.0, 100.0)], cash=40_000.0)["A"][0] == "approved"
    assert _budget(spark, [("A", d, "BUY", 20_000, 0.9, 10_000.0, 0.0)])["A"] == ("trimmed", 100.0, "volume")
    for regime, room in folds.REGIME_ROOM.items():
        got = _budget(spark, [("A", d, "BUY", 20_000, 0.9, 0.0, 0.0), ("B", d, "BUY", 10_000, 0.8, 0.0, 0.0)], regime=regime)
        assert abs(sum(v[1] for v in got.values()) - min(300, 400 * room)) <= 1
    order = _budget(spark, [("LOW", d, "BUY", 20_000, 0.2, 0.0, 0.0), ("TOP", d, "BUY", 20_000, 0.9, 0.0, 0.0), ("MID", d, "BUY", 20_000, 0.5, 0.0, 0.0)])
    assert order["TOP"][0] == order["MID"][0] == "approved" and order["LOW"][0] == "rejected"
    assert folds.risk_budget(spark.createDataFrame([], PLAN), spark.createDataFrame([], ACCOUNT)).count() == 0


# Failure isolation


def test_failures_stay_with_their_rule(spark):
    rows = [("A", _day(k), 100.0 + k, 10.0 if k % 4 else 0.0, k + 1) for k in range(12)] + [("B", _day(0), 1.0, 0.0, 1)]
    panel = spark.createDataFrame(rows, "symbol string, date date, close double, volume double, n_bars int")

    def divides(g):
        return pd.DataFrame({"action": "BUY", "confidence": [1 / int(v) for v in g["volume"]], "target_weight": 0.0})

    rules = [
        strategies.Strategy("ok", 1, lambda: strategies.decision("HOLD", 0.5)), strategies.Strategy("divides", 3, lambda: strategies.guarded(divides, "volume")),
        strategies.Strategy("nothing", 1, lambda: strategies.guarded(lambda g: None, "close")), strategies.Strategy("raises", 1, lambda: 1 // 0),
        strategies.Strategy("unplannable", 1, lambda: strategies.decision("BUY", F.col("absent"))), strategies.Strategy("null", 1, lambda: F.when(F.col("close") < 0, strategies.decision("BUY", 1.0))),
    ]
    good, failed = strategies.isolated_signals(panel, rules)
    counts = {r.agent: r["count"] for r in good.groupBy("agent").count().collect()}
    assert counts == {"ok": 13, "divides": 8}
    wrong = {r.agent: (r.symbols, r.n) for r in logs.failure_summary(failed).collect()}
    assert wrong == {"divides": (1, 2), "nothing": (2, 13), "raises": (2, 13), "unplannable": (2, 13), "null": (2, 13)}
    errors = {r.agent: r.error for r in failed.collect()}
    assert errors["divides"] == "ZeroDivisionError: division by zero" and "NoneType" in errors["nothing"] and errors["raises"].startswith("ZeroDivisionError") and "absent" in errors["unplannable"]
    health = {(r.symbol, r.date): (r.responders, r.degraded) for r in logs.degraded_runs(good.where("agent = 'divides'"), 2, runs=panel, key=("symbol", "date")).collect()}
    assert health["B", _day(0)] == (0, True) and health["A", _day(3)] == (1, False) and len(health) == 13


@pytest.mark.parametrize("n,least", [(1, 1), (2, 1), (5, 3), (6, 3), (7, 4)])
def test_quorum(spark, n, least):
    rows = spark.createDataFrame([("p", f"a{k}") for k in range(least - 1)] + [("q", f"a{k}") for k in range(least)], "plan_id string, agent string")
    runs = spark.createDataFrame([("p",), ("q",)], "plan_id string")
    assert {r.plan_id: r.degraded for r in logs.degraded_runs(rows, n, runs=runs).collect()} == {"p": True, "q": False}


# Resampling


def test_block_draws_by_hand(spark):
    rng = np.random.default_rng(9)
    series = {"x": rng.normal(0, 1, 47), "y": rng.normal(1, 1, 5)}
    frame = spark.createDataFrame([(g, _day(3 * k), float(v)) for g, vs in series.items() for k, v in enumerate(vs)], "g string, date date, v double")
    got = {(r.g, r.draw): r.total for r in edge.block_draws(frame, ["g"], F.lit(20), 50, 3, {"total": "v"}).collect()}
    p = edge.PRIME
    for g, vs in series.items():
        n = len(vs)
        for draw in range(50):
            total = 0.0
            for part in range(-(-n // 20)):
                x = (draw * 48271 + part * 69621 + 3) % p
                x = (x * 16807 + 12345) % p
                start = (((x * x + 7) % p) * 48271 + 1) % p % n
                total += sum(vs[(start + k) % n] for k in range(min(20, n - 20 * part)))
            assert abs(got[g, draw] - total) < 1e-9
    r = edge.mean_interval(frame, "v", ["g"], 4).collect()
    assert [x.g for x in r] == ["x"] and r[0].low < r[0].mean < r[0].high
    starts = spark.range(20000).select((edge.drawn(F.col("id") % 2000, F.floor(F.col("id") / 2000), 1) % 50).alias("s"))
    counts = starts.groupBy("s").count().toPandas()["count"]
    assert len(counts) == 50 and counts.min() > 300 and counts.max() < 500


# Equivalence


def test_audit_finds_a_wrong_rule(spark):
    bars = view(spark, SF, "bars")
    signals = strategies.signals(features.features(bars))
    rules = {**audit.ROW_RULES, "multifactor": lambda h: "BUY"}
    got = {r.agent: (r.n_points, r.n_mismatches) for r in audit.equivalence(bars, signals, rules).collect()}
    assert got["mean_reversion"][0] == got["multifactor"][0] > 5 and got["mean_reversion"][1] == got["trend_following"][1] == 0 and got["multifactor"][1] > 0


# Regressions


def test_regressions_equal_plain_least_squares(spark):
    rng = np.random.default_rng(10)
    names, n = ["f0", "f1", "f2", "f3"], 700
    x = rng.normal(0, 0.01, (n, 4))
    factors = spark.createDataFrame([(_day(k), *map(float, r), 0.0001) for k, r in enumerate(x)] + [(_day(n), None, 0.0, 0.0, 0.0, 0.0)], "date date, f0 double, f1 double, f2 double, f3 double, rf double")
    rows, noise = [], 0.0
    for a, (alpha, beta, days) in {"A": (0.001, (1.2, 0, -0.4, 0), n), "B": (0.0, (0, 0, 0, 0), 90), "C": (-0.002, (0.5, 0.5, 0.5, 0.5), n + 1), "few": (0.0, (1, 0, 0, 0), 59)}.items():
        for k in range(days):
            noise = 0.5 * noise + rng.normal(0, 0.005)  # errors that remember
            rows.append((a, _day(k), float(alpha + (x[k] @ beta if k < n else 0) + noise)))
    rows += [("same", _day(k), 0.01) for k in range(200)]
    got = statistics.factor_regressions(spark.createDataFrame(rows, "agent string, date date, ret double").repartition(5), factors, names).toPandas()
    assert set(got.agent) == {"A", "B", "C"}
    for agent in "ABC":
        y = np.array([r[2] - 0.0001 for r in rows if r[0] == agent][:n])
        want = statistics.newey_west(y, np.column_stack([np.ones(len(y)), x[: len(y)]]))
        mine = got[got.agent == agent].set_index("term").loc[["alpha", *names]]
        assert np.allclose(mine.coef, want["beta"], atol=1e-9) and np.allclose(mine.t, want["t"], atol=1e-6) and np.allclose(mine.p, want["p"], atol=1e-7)
        assert np.allclose(mine[["r2", "adj_r2", "resid_vol"]].iloc[0], [want["r2"], want["adj_r2"], want["resid_vol"]], atol=1e-9) and mine.n.iloc[0] == want["n"] == len(y)


def test_veto_by_hand(spark):
    buys = spark.createDataFrame([("r", "A", 0.9), ("r", "B", 0.8), ("r", "C", 0.7), ("q", "A", 0.1), ("q", "D", 0.1)], "run_id string, symbol string, confidence double")
    held = spark.createDataFrame([("r", "E")], "run_id string, symbol string")
    corr = spark.createDataFrame([("A", "B", 0.8), ("C", "E", -0.9), ("A", "D", 0.69)], "a string, b string, corr double")
    assert {(r.run_id, r.symbol): r.approved for r in folds.correlation_veto(buys, held, corr).collect()} == {("r", "A"): True, ("r", "B"): False, ("r", "C"): False, ("q", "A"): True, ("q", "D"): True}
    assert {(r.a, r.b) for r in folds.wanted_pairs(buys, held).collect()} == {("A", "B"), ("A", "C"), ("B", "C"), ("A", "E"), ("B", "E"), ("C", "E"), ("A", "D")}
