"""Queries over numpy helpers and sequential folds: not expressible in SQL, tested against plain recomputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantpanel.operators import audit, edge, features, folds, risk, statistics, strategies, trades
from quantpanel.sources.scratch import written

from .common import Catalog, duck, view
from .signal_queries import LABELS, RETURNS, SIGNALS, edge_tables

CATALOG = Catalog()
add = CATALOG.add
C = F.col


def _panel(s, d):
    return features.features(view(s, d, "bars"))


def _rows(s, d):
    """Decisions with the returns before and after them, from one written pass over the bars."""
    return written(strategies.decided(_panel(s, d), keep=("ret1", "fwd_1")), "decisions-and-returns")


def _ordered(s, d):
    """Decisions on each symbol's bars in order, with what backtests read."""
    return strategies.decided(features.features(view(s, d, "bars"), ()), keep=("n_bars", "close", "regime"))


def _agent_returns(rows):
    """Equal-weight next-day return of each strategy's BUY names."""
    return strategies.unfolded(rows).where("action = 'BUY' AND error IS NULL").groupBy("agent", "date").agg(F.avg("fwd_1").alias("ret")).where("ret IS NOT NULL")


NAMES = ["f0", "f1", "f2", "f3"]


def _factors(rows):
    """Mean return of the symbols by the last digit of their number."""
    kind = F.concat(F.lit("f"), (F.substring("symbol", 2, 9).cast("int") % 4).cast("string"))
    return rows.where("ret1 IS NOT NULL").withColumn("k", kind).groupBy("date").pivot("k", NAMES).agg(F.avg("ret1")).withColumn("rf", F.lit(0.04 / 252)).na.drop()


def _regressions(s, d):
    rows = _rows(s, d)
    return statistics.factor_regressions(_agent_returns(rows), _factors(rows), NAMES)


def _moments(s, d):
    """The normal equations, rounded, a row per entry."""
    rows = _rows(s, d)
    found = statistics.regression_moments(statistics.regression_rows(_agent_returns(rows), _factors(rows), NAMES), 5)
    return found.select("agent", "n", F.posexplode(F.concat("xx", "xy")).alias("entry", "value")).withColumn("value", C("value") * 1000)


def _validated(s, d):
    """Pairs of a sector that move alike, tested; no symbol is set against all others."""
    rows, sectors = view(s, d, "bars"), view(s, d, "sectors").withColumnRenamed("ticker", "symbol")
    return statistics.validate_sketched(rows, sectors)


def _plans(s, d):
    last = risk.tail_closes(view(s, d, "bars"), 10).groupBy("symbol").agg(F.max_by("close", "date").alias("price"), F.avg("volume").alias("adv"))
    rows = view(s, d, "decisions").where("action <> 'HOLD'").select(C("plan_id").alias("run_id"), "symbol", "action", "confidence", "timestamp", "ordinal", (1 + C("ordinal") % 50).cast("double").alias("qty"))
    newest = rows.groupBy("run_id", "symbol").agg(F.max_by(F.struct("action", "confidence", "qty"), F.struct("timestamp", "ordinal")).alias("x")).select("run_id", "symbol", "x.*")
    return newest.join(last, "symbol").withColumn("adv", C("adv") * 100)


def _budget_plans(s, d):
    """Pairs, trend and directional plans by the symbol's number, with positions on both sides."""
    k = F.substring("symbol", 2, 9).cast("int")
    kind = F.when(k % 5 == 0, "market_neutral").when(k % 5 == 1, "cta_trend").otherwise("directional")
    return _plans(s, d).withColumn("price", F.round("price", 2)).withColumn("adv", C("adv") * 0.973 + 0.377).withColumn("strategy", kind).withColumn("current_qty", ((k + C("qty").cast("int")) % 5 - 2.0) * 10)


def _account(s, d):
    runs = view(s, d, "decisions").select(C("plan_id").alias("run_id")).distinct().withColumn("k", F.substring("run_id", 2, 9).cast("int"))
    regime = F.element_at(F.array(*map(F.lit, ("bull_quiet", "bull_volatile", "sideways", "bear", "unknown"))), C("k") % 5 + 1)
    return runs.select("run_id", F.lit(20_000.0).alias("netliq"), F.lit(12_000.0).alias("cash"), F.lit(1_500.0).alias("net_long"), regime.alias("regime"), (C("k") % 9 == 8).alias("sell_only"))


_PLANS = duck("bars", "decisions") + """, la AS (SELECT symbol, ARG_MAX(close, date) AS price, AVG(volume) AS adv FROM (SELECT * FROM bars QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) <= 10) GROUP BY 1),
nw AS (SELECT plan_id AS run_id, symbol, action, confidence, CAST(1 + ordinal % 50 AS DOUBLE) AS qty FROM decisions WHERE action <> 'HOLD' QUALIFY ROW_NUMBER() OVER (PARTITION BY plan_id, symbol ORDER BY timestamp DESC, ordinal DESC) = 1),
pb AS (SELECT nw.*, ROUND(price, 2) AS price, adv * 100 * 0.973::DOUBLE + 0.377::DOUBLE AS adv, CASE CAST(SUBSTR(symbol, 2) AS INT) % 5 WHEN 0 THEN 'market_neutral' WHEN 1 THEN 'cta_trend' ELSE 'directional' END AS strategy,
       ((CAST(SUBSTR(symbol, 2) AS INT) + CAST(qty AS INT)) % 5 - 2.0::DOUBLE) * 10 AS current_qty FROM nw JOIN la USING (symbol)),
ac AS (SELECT run_id, [1.0, 0.75, 0.6, 0.35, 1.0][CAST(SUBSTR(run_id, 2) AS INT) % 5 + 1]::DOUBLE AS room, CAST(SUBSTR(run_id, 2) AS INT) % 9 = 8 AS sell_only FROM (SELECT DISTINCT plan_id AS run_id FROM decisions)),
od AS (SELECT *, qty * price AS nt, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY action = 'SELL' OR ABS(current_qty + qty) < ABS(current_qty) - 1e-9 DESC, confidence DESC, qty * price DESC, symbol) AS k,
       SUM(CASE WHEN strategy = 'directional' AND current_qty > 0 THEN current_qty * price ELSE 0 END) OVER (PARTITION BY run_id) AS l0, SUM(CASE WHEN strategy = 'market_neutral' THEN ABS(current_qty) * price ELSE 0 END) OVER (PARTITION BY run_id) AS p0,
       SUM(CASE WHEN strategy = 'cta_trend' THEN ABS(current_qty) * price ELSE 0 END) OVER (PARTITION BY run_id) AS t0 FROM pb),
st AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS k, 1500 + l0 AS lg, CAST(12000 AS DOUBLE) AS cash, p0 AS pg, t0 AS tg, '' AS symbol, '' AS strategy, '' AS action, CAST(0 AS DOUBLE) AS ok, '' AS outcome, '' AS reason FROM od
  UNION ALL SELECT run_id, k, CASE WHEN strategy = 'directional' THEN CASE action WHEN 'SELL' THEN GREATEST(0, lg - nt) ELSE lg + ok * price END ELSE lg END, CASE WHEN strategy = 'directional' THEN CASE action WHEN 'SELL' THEN cash + nt ELSE cash - ok * price END ELSE cash END,
    CASE WHEN strategy = 'market_neutral' THEN CASE action WHEN 'SELL' THEN GREATEST(0, pg - nt) ELSE pg + ok * price END ELSE pg END, CASE WHEN strategy = 'cta_trend' THEN CASE WHEN closes THEN GREATEST(0, tg - nt) ELSE tg + ok * price END ELSE tg END,
    symbol, strategy, action, ok, CASE WHEN ok = 0 THEN 'rejected' WHEN ok < qty THEN 'trimmed' ELSE 'approved' END, CASE WHEN ok = qty THEN '' ELSE why END
  FROM (SELECT *, CASE WHEN strategy = 'cta_trend' THEN CASE WHEN closes OR (NOT sell_only AND (tg + nt) / 20000 <= 0.60) THEN qty ELSE 0 END WHEN action = 'SELL' THEN qty WHEN sell_only THEN 0 WHEN strategy = 'market_neutral' THEN CASE WHEN (pg + nt) / 20000 <= 0.30 THEN qty ELSE 0 END
        WHEN room <= 0 THEN 0 WHEN nt <= room THEN qty WHEN FLOOR(room / price) < 1 OR FLOOR(room / price) * price < 0.25 * nt THEN 0 ELSE FLOOR(room / price) END AS ok,
        CASE WHEN sell_only THEN 'sell only' WHEN strategy <> 'directional' THEN strategy WHEN room = 4000 THEN 'name' WHEN room = lroom THEN 'net long' WHEN room = croom THEN 'cash' ELSE 'volume' END AS why
    FROM (SELECT *, LEAST(4000, lroom, croom, 0.01 * adv * price) AS room FROM (SELECT od.*, lg, cash, pg, tg, sell_only, (od.action = 'SELL' AND current_qty > 0) OR (od.action = 'BUY' AND current_qty < 0) AS closes, 0.40 * ac.room * 20000 - lg AS lroom, cash - 0.30 * 20000 AS croom
      FROM st JOIN od ON od.run_id = st.run_id AND od.k = st.k + 1 JOIN ac ON ac.run_id = st.run_id))))"""


add("d08_significance", lambda s, d: (lambda sig, ret: statistics.significance(edge.labelled(sig, ret).groupBy("agent", "horizon").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.countDistinct("date").alias("n_dates"))))(*edge_tables(s, d)),
    SIGNALS + RETURNS + LABELS + """, c AS (SELECT agent, horizon, COUNT(*) AS n, CAST(SUM(hit) AS BIGINT) AS hits, COUNT(DISTINCT date) AS n_dates FROM lab GROUP BY 1, 2),
    p AS (SELECT *, LEAST(1, LIST_SUM(LIST_TRANSFORM(GENERATE_SERIES(hits, n), lambda i: EXP(LGAMMA(n + 1) - LGAMMA(i + 1) - LGAMMA(n - i + 1) - n * LN(2))))) AS p FROM c)
    SELECT agent, horizon, n, hits, n_dates, ROUND(p, 6)::DOUBLE AS p_value, CASE WHEN n_dates < 60 THEN 'few dates' WHEN n < 30 THEN 'few signals' WHEN p < 0.05 THEN 'edge' ELSE 'no edge' END AS verdict FROM p""")  # fmt: skip
add("d37_factor_regressions", _regressions)
_TERMS = ["1", *NAMES]
add("d37_normal_equations", _moments,
    SIGNALS + """, f1r AS (SELECT symbol, date, close / LAG(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r, LN(LEAD(close, 1) OVER (PARTITION BY symbol ORDER BY date) / close) AS nx FROM bars),
    fa AS (SELECT date, """ + ", ".join(f"AVG(r) FILTER (CAST(SUBSTR(symbol, 2) AS INT) % 4 = {k}) AS f{k}" for k in range(4)) + f""" FROM f1r GROUP BY 1),
    ar AS (SELECT agent, date, AVG(nx) - 0.04 / 252 AS y FROM signals JOIN f1r USING (symbol, date) WHERE action = 'BUY' GROUP BY 1, 2 HAVING AVG(nx) IS NOT NULL),
    j AS (SELECT * FROM ar JOIN fa USING (date) WHERE f0 IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL),
    m AS (SELECT agent, COUNT(*) AS n, [{", ".join(f"SUM({a} * {b})" for a in _TERMS for b in _TERMS)}, {", ".join(f"SUM({a} * y)" for a in _TERMS)}]::DOUBLE[] AS v FROM j GROUP BY 1)
    SELECT agent, n, CAST(k AS INT) AS entry, ROUND(v[k + 1] * 1000, 6) AS value FROM (SELECT *, UNNEST(RANGE(30)) AS k FROM m)""")  # fmt: skip
add("d38_factor_verdicts", lambda s, d: statistics.factor_verdict(_regressions(s, d)))
add("i13_pair_validation", _validated)
# the budgets go from row to row
add("j04_risk_budget", lambda s, d: folds.risk_budget(_budget_plans(s, d), _account(s, d), folds.Limits(net_long=0.40)),
    "WITH RECURSIVE " + _PLANS[5:] + " SELECT run_id, symbol, strategy, action, ok AS approved_qty, outcome, reason FROM st WHERE k > 0")
def _veto(s, d):
    plans = written(_plans(s, d), "plans")
    buys, held = plans.where("action = 'BUY'").select("run_id", "symbol", "confidence"), plans.where("action = 'SELL'").select("run_id", "symbol")
    return folds.correlation_veto(buys, held, risk.pair_correlations(view(s, d, "bars"), folds.wanted_pairs(buys, held), 400, 5), 0.6)


add("j05_correlation_veto", _veto,
    "WITH RECURSIVE " + duck("bars", "decisions")[5:] + """, nw AS (SELECT plan_id AS run_id, symbol, action, confidence FROM decisions WHERE action <> 'HOLD' AND symbol IN (SELECT symbol FROM bars) QUALIFY ROW_NUMBER() OVER (PARTITION BY plan_id, symbol ORDER BY timestamp DESC, ordinal DESC) = 1),
    t AS (SELECT * FROM bars QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) <= 401), r AS (SELECT symbol, date, close / LAG(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM t),
    cr AS (SELECT x.symbol AS a, y.symbol AS b FROM r x JOIN r y ON x.date = y.date AND x.symbol <> y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 5 AND ABS(CORR(x.ret, y.ret)) >= 0.6), fo AS (SELECT a AS symbol, LIST(b) AS foes FROM cr GROUP BY 1),
    bu AS (SELECT run_id, symbol, COALESCE(foes, []) AS foes, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY confidence DESC, symbol) AS k FROM nw LEFT JOIN fo USING (symbol) WHERE action = 'BUY'), hd AS (SELECT run_id, LIST(symbol) AS held FROM nw WHERE action = 'SELL' GROUP BY 1),
    st AS (SELECT run_id, CAST(0 AS BIGINT) AS k, COALESCE(held, []) AS taken, '' AS symbol, FALSE AS approved FROM (SELECT DISTINCT run_id FROM bu) LEFT JOIN hd USING (run_id)
      UNION ALL SELECT bu.run_id, bu.k, CASE WHEN LIST_HAS_ANY(foes, taken) THEN taken ELSE LIST_APPEND(taken, bu.symbol) END, bu.symbol, NOT LIST_HAS_ANY(foes, taken) FROM st JOIN bu ON bu.run_id = st.run_id AND bu.k = st.k + 1)
    SELECT run_id, symbol, approved FROM st WHERE k > 0""")  # fmt: skip
# written for the short methods of its write; a row per strategy and symbol
add("j06_backtests", lambda s, d: written(folds.backtests_in_order(_ordered(s, d), strategies.names()), "backtests"))
add("j07_walk_forward", lambda s, d: written(folds.walk_forward_in_order(_ordered(s, d), strategies.names()), "walk-forward"))
add("j09_path_bootstrap", lambda s, d: statistics.path_summary(statistics.path_bootstrap(trades.round_trips(view(s, d, "executions"), trades.winners(view(s, d, "decisions"))).select("agent", "ret"), 10_000, 90, cost=0.0009)))


# every point agrees: the SQL counts the sampled points of each rule
add("j10_equivalence", lambda s, d: audit.equivalence(view(s, d, "bars"), strategies.signals(_panel(s, d), list(audit.ROW_RULES)), audit.ROW_RULES),
    duck("bars") + f""", n AS (SELECT symbol, date, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars), p AS (SELECT * FROM n WHERE (n * 7919 + CAST(SUBSTR(symbol, 2) AS INT) * 104729) % {audit.ONE_IN} = 0 AND n > {audit.FIRST})
    SELECT agent, (SELECT COUNT(*) FROM p) AS n_points, 0 AS n_mismatches FROM (SELECT UNNEST(['mean_reversion', 'trend_following']) AS agent)""")  # fmt: skip
