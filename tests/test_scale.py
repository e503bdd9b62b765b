"""Steps that must grow no faster than their input."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quantpanel.functions import panel
from quantpanel.operators import edge, features, folds, reports, risk, statistics, strategies
from quantpanel.sources import lake


def _day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_forward_as_of_reads_each_row_once(spark):
    bars = spark.createDataFrame([("S", _day(2 * k), 100.0 + k) for k in range(20)], "symbol string, date date, close double")
    asked = [(k, "S", _day(k) if k < 45 else None, "BUY") for k in range(46)]
    rows = spark.createDataFrame(asked, "ordinal long, symbol string, day date, action string")
    got = reports.next_session_returns(rows, bars, 3)
    # a frame that ends at the last row is added up anew for each row
    assert "unboundedfollowing" not in _plan(got).lower() and "unboundedfollowing" not in _plan(reports.shadow_outcomes(rows, bars)).lower()
    for r in got.collect():
        at = None if r.day is None else -(-(r.day - _day(0)).days // 2)
        if at is None or at + 3 > 19:
            assert r.fwd is None
        else:
            assert abs(r.fwd - math.log((103 + at) / (100 + at))) < 1e-12
    assert {r.h for r in reports.shadow_outcomes(rows, bars).collect()} == {1, 3, 5}


def test_snapshot_files_are_fewer_than_symbols(spark, tmp_path):
    bars = spark.createDataFrame([(f"S{k}", _day(i), *[float(k + i)] * 4, 1.0) for k in range(60) for i in range(3)], "symbol string, date date, open double, high double, low double, close double, volume double")
    path = f"{tmp_path}/snap"
    lake.write_snapshot(bars, path)
    folder = next(p for p in (tmp_path / "snap").iterdir() if p.name.startswith("bars-"))
    assert len(list(folder.rglob("*.parquet"))) <= 4
    rows, listed = lake.read_snapshot(spark, path)
    assert rows.count() == 180 and listed.count() == 60 and lake.tampered(spark, path).count() == 0


def test_six_places_as_printed(spark):
    odd = [0.0, -0.0, 1e-7, 5e-7, 1e-6, 1.0000005, 2.5000005, 1e9, 1e12, -3.5, float("nan"), float("inf"), None, 999999999.9999995]
    rows = spark.createDataFrame([(x,) for x in odd], "x double").select(lake._six_places(F.col("x")).alias("a"), F.format_string("%.6f", "x").alias("b"))
    assert all(r.a == r.b for r in rows.collect())


def test_correlation_blocks_grow_with_the_symbols(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"S{k}", _day(i), 100.0 + rng.random()) for k in range(40) for i in range(25)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    sizes = []
    monkeypatch.setattr(risk, "BLOCK_SYMBOLS", 8)
    monkeypatch.setattr(risk.F, "pmod", lambda x, n, real=F.pmod: sizes.append(n) or real(x, n))
    got = {(r.a, r.b): (r.n, round(r.corr, 9)) for r in risk.correlations(bars, 20, 5).collect()}
    assert len(sizes) == 1 and "5" in str(sizes[0])  # 40 symbols in blocks of 8
    one = {(r.a, r.b): (r.n, round(r.corr, 9)) for r in risk.correlations(bars, 20, 5, blocks=1).collect()}
    assert got == one and len(got) == 40 * 39 // 2


def test_long_frames_are_put_together_of_parts(spark):
    rng = random.Random(9)
    closes = [None if rng.random() < 0.05 else rng.uniform(50, 150) for _ in range(130)]
    bars = spark.createDataFrame([("S", _day(i), c) for i, c in enumerate(closes)], "symbol string, date date, close double")
    got = panel.with_long_frames(bars, 10, {"mean": ("avg", "close", 50), "high": ("max", "close", 60), "low": ("min", "close", 10)})
    assert "-49" not in _plan(got) and "-59" not in _plan(got)  # no frame slides over all of its rows
    for i, r in enumerate(sorted(got.collect(), key=lambda r: r.date)):
        of = lambda n: [c for c in closes[max(0, i - n + 1) : i + 1] if c is not None]  # noqa: B023, E731
        assert r.high == max(of(60), default=None) and r.low == min(of(10), default=None)
        assert r["mean"] is None if len(of(50)) < 50 else abs(r["mean"] - sum(of(50)) / 50) < 1e-9


def test_moving_averages_slide_over_short_frames(spark):
    bars = spark.createDataFrame([("S", _day(i), 100.0 + i) for i in range(30)], "symbol string, date date, close double")
    assert "-199" not in _plan(features.moving_averages(bars)) and "-251" not in _plan(features.volatility(bars))


def test_calibration_of_carried_returns_keeps_to_its_horizon(spark):
    said = spark.createDataFrame([("A", "S", _day(k), "BUY", 0.6, 0.01, -0.01, 0.01) for k in range(4)], "agent string, symbol string, date date, action string, confidence double, fwd_1 double, fwd_5 double, fwd_20 double")
    (got,) = edge.calibration(said, edge.long_returns(said)).collect()
    assert (got.n, got.n_dates, got.hit_rate) == (4, 4, 0.0)


def test_sweeps_equal_windows(spark):
    """Frames over batches that cut symbols, with missing values and short histories, against window functions; no window but the row number and the labels stays in the plan."""
    rng = random.Random(3)
    rows = [(f"S{s}", _day(k), None if rng.random() < 0.05 else round(rng.uniform(1, 9), 2)) for s, n in enumerate((1, 4, 40, 90)) for k in range(n)]
    frame = panel.in_order(spark.createDataFrame(rows, "symbol string, date date, x double"))
    made = {f"{op}{n}_{back}_{least}": panel.Frame(op, "x", n, back, least) for op in ("avg", "max", "min", "std") for n in (5, 20) for back in (0, 1) for least in (None, 2)}
    made |= {f"lag{k}": panel.Frame("lag", "x", back=k) for k in (1, 7)}
    agg = {"avg": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp}
    want = {k: panel.lag("x", f.back) if f.op == "lag" else panel.rolling(agg[f.op], "x", f.n, f.least, f.back) for k, f in made.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = panel.swept(frame, **made).withColumns({f"_{k}": c for k, c in want.items()}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for r in got:
        for k in made:
            assert (r[k] is None) == (r[f"_{k}"] is None) and (r[k] is None or abs(r[k] - r[f"_{k}"]) < 1e-12), (k, r)
    bars = spark.createDataFrame([("S", _day(k), *[100.0 + k] * 4, 1.0) for k in range(5)], "symbol string, date date, open double, high double, low double, close double, volume double")
    assert _plan(features.features(bars)).count("windowspecdefinition") == 4


def test_excess_by_regime_without_a_join(spark):
    """Signals that carry their returns give what the join with all returns gives."""
    rows = [(f"S{s}", _day(k), "a", "BUY" if (s + k) % 3 else "HOLD", None if k > 50 else 0.01 * ((s * k) % 7 - 3)) for s in range(4) for k in range(60)]
    signals = spark.createDataFrame(rows, "symbol string, date date, agent string, action string, fwd_5 double")
    returns, falls = edge.long_returns(signals, (5,)), spark.createDataFrame([(_day(k), 0.004 * k) for k in range(55)], "date date, drawdown double")
    plain, own = (sorted((r.bucket, r.n, None if r.excess is None else round(r.excess, 9)) for r in edge.regime_excess(x, returns, falls, least=5).collect()) for x in (signals.drop("fwd_5"), signals))
    assert plain == own and [r[0] for r in own] == ["0-5", "10-20", "20+", "5-10"]


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_returns_meet_without_a_shuffle(spark):
    """Returns are written in their block once; no exchange or sort sends them once a pair of blocks, and no block goes to all tasks."""
    rng = random.Random(8)
    rows = [(f"S{k}", _day(i + k % 3), 100.0 + rng.random()) for k in range(23) for i in range(12)] + [(None, _day(i), 100.0 + i) for i in range(12)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    got = risk.correlations(bars, 10, 5, blocks=6)
    assert not any(step in _physical(got) for step in ("Exchange", "Sort", "Broadcast")) and "CartesianProduct" in _physical(got)
    pairs = [(r.a, r.b) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) == 23 * 22 // 2 and all(a < b for a, b in pairs)


def test_sketched_pairs_need_no_table_of_candidates(spark):
    """The same rows as candidates that are listed first, for any size of block and symbols of several groups; the plan after the written prices has no exchange."""
    rng = random.Random(6)
    level = {f"S{s}": 0.0 for s in range(24)}
    rows = [(s, _day(i), math.exp(level[s])) for i in range(190) for s in level if level.update({s: level[s] + rng.gauss(0, 0.01)}) or i >= 8 * (int(s[1:]) % 12)]
    rows += [("TWIN", d, 2 * c) for s, d, c in rows if s == "S3"] + [("ONE", _day(i), 1.0) for i in range(150)] + [("LATE", _day(300 + i), 1.0 + i) for i in range(140)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    groups = [(s, "x" if k % 2 else "y") for k, s in enumerate([*level, "TWIN", "ONE", "LATE", "NEVER"])] + [("S3", "y"), ("TWIN", "x"), ("S5", "y"), ("S5", None), ("S5", "x")]
    groups = spark.createDataFrame(groups, "symbol string, sector string")
    want = statistics.validate_pairs(bars, statistics.sketch_candidates(bars, groups)).collect()
    assert len(want) > 20 and {"short"} < {r.reasons for r in want}
    for block in (1000, 5, 1):
        got = statistics.validate_sketched(bars, groups, block=block)
        assert not any(step in _physical(got) for step in ("Exchange", "Sort", "Broadcast"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want))
    assert statistics.validate_sketched(bars, groups.where("symbol = 'NEVER'")).collect() == []


def test_backtests_where_the_rows_are(spark):
    """Over batches that cut symbols the same rows as groups of unfolded signals, short histories and a silent strategy too; nothing is shuffled after the features."""
    rng, level, rows = random.Random(7), {}, []
    for s, n in (("A", 560), ("B", 30), ("C", 700), ("D", 503), ("E", 1), ("F", 504)):
        for k in range(n):
            level[s] = level.get(s, 0.0) + rng.gauss(0.002 * math.sin(k / 40), 0.02)
            c = math.exp(level[s]) * 50
            rows.append((s, _day(k), c, c * 1.01, c * 0.99, c, float(rng.randint(1, 90))))
    bars = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    names = strategies.names()
    decided = strategies.decided(features.features(bars, ()), keep=("n_bars", "close", "regime"))
    signals = strategies.unfolded(decided).where("error IS NULL")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        pairs = [(folds.backtests(signals), folds.backtests_in_order(decided, names)), (folds.walk_forward(signals, None, risk.walk_forward_windows(bars)), folds.walk_forward_in_order(decided, names))]
        for want, got in pairs:
            assert _physical(got).count("Exchange") == 1 and "FlatMapGroups" not in _physical(got)
            want = sorted(map(str, want.collect()))
            assert len(want) > 10 and sorted(map(str, got.select(want_columns(want[0])).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def want_columns(row):
    return [part.split("=")[0] for part in row[4:-1].split(", ")]


def test_trades_one_after_another():
    """From trade to trade as from bar to bar."""
    rng = np.random.default_rng(3)
    for first in (0, 15):
        close, action = np.exp(np.cumsum(rng.normal(0, 0.02, 400))) * 20_000, rng.choice(["BUY", "SELL", "HOLD"], 400)
        close[:40] *= 10  # too dear at first
        sure, regime = rng.uniform(0.5, 1, 400), rng.choice(["bull", "bear"], 400)
        cash, qty, last, equity, done = 100_000.0, 0, -folds.COOLDOWN, [], []
        for i in range(first, 400):
            if i - last >= folds.COOLDOWN and action[i] == "BUY" and qty == 0 and int(0.95 * cash / close[i]):
                qty, last = int(0.95 * cash / close[i]), i
                cash -= qty * close[i] * (1 + folds.COST)
                done.append(("BUY", close[i]))
            elif i - last >= folds.COOLDOWN and action[i] == "SELL" and qty and not (regime[i] == "bull" and sure[i] < 0.90):
                cash, qty, last = cash + qty * close[i] * (1 - folds.COST), 0, i
                done.append(("SELL", close[i]))
            equity.append(cash + qty * close[i])
        got = folds.simulate(close, action, sure, regime, first)
        assert got[1] == done and len(done) > 5 and np.allclose(got[0], equity, rtol=1e-12)


def test_a_rule_that_fails_on_some_rows_is_asked_seldom():
    """Equal rows that raise are found once; the answers are those of each row alone."""
    asked = []

    def rule(rows):
        asked.append(len(rows))
        if (rows["x"] == 3).any() or rows["t"].isna().any():
            raise ValueError("no")
        return rows.assign(action=np.where(np.signbit(rows["x"]), "SELL", "BUY"), confidence=rows["x"] / 10, target_weight=0.0)

    rng = random.Random(2)
    data = pd.DataFrame([(rng.choice([0.0, -0.0, 1.0, 2.0, 3.0]), rng.choice(["a", "b", None])) for _ in range(3000)], columns=["x", "t"])
    run = {}
    real = strategies.F.pandas_udf
    strategies.F.pandas_udf = lambda f, schema: run.update(f=f) or (lambda *c: None)
    try:
        strategies.guarded(rule, "x", "t")
    finally:
        strategies.F.pandas_udf = real
    got = run["f"](data["x"], data["t"])
    assert len(asked) < 60 and len(got) == 3000 and len(run["f"](data["x"][:0], data["t"][:0])) == 0
    for (x, t), r in zip(data.itertuples(index=False), got.itertuples()):
        bad = x == 3 or t is None
        assert (r.error == "ValueError: no" and r.action is None) if bad else (r.error is None and r.confidence == x / 10 and r.action == ("SELL" if math.copysign(1, x) < 0 else "BUY"))
