"""As-of returns, curves, order plans and smaller reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.panel import by_symbol
from quantpanel.operators import ranking, reports, risk, trades

from .common import Catalog, duck, view
from .log_queries import TRIPS, _trips
from .risk_queries import BOOKS, PAIRS, WALK_FORWARD, books, neighbours

CATALOG = Catalog()
add = CATALOG.add
C = F.col
_P = "OVER (PARTITION BY symbol ORDER BY date)"


def bars(s, d):
    return view(s, d, "bars")


def _asked(s, d):
    """Decisions moved onto the calendar of the bars."""
    return view(s, d, "decisions").select("ordinal", "symbol", "action", "regime", F.date_sub(F.to_date("timestamp"), 9000 - (C("ordinal") % 2000).cast("int")).alias("day"))


_ASK = ", ask AS (SELECT ordinal, symbol, action, regime, CAST(timestamp AS DATE) - CAST(9000 - ordinal % 2000 AS INTEGER) AS day FROM decisions)"
add("c02_next_session_returns", lambda s, d: reports.next_session_returns(_asked(s, d), bars(s, d), 5).select("ordinal", "fwd"),
    duck("bars", "decisions") + _ASK + f""", b AS (SELECT symbol, date, close, LEAD(close, 5) {_P} AS later FROM bars)
    SELECT ordinal, ROUND(LN(later / close), 6) AS fwd FROM ask ASOF LEFT JOIN b ON ask.symbol = b.symbol AND ask.day <= b.date""")  # fmt: skip
_C3 = duck("bars", "decisions") + _ASK + f""", b AS (SELECT symbol, date, close, LEAD(close, 5) {_P} AS later FROM bars),
er AS (SELECT ordinal, regime, later / close - 1 AS ret FROM ask ASOF LEFT JOIN b ON ask.symbol = b.symbol AND ask.day >= b.date)"""
add("c03_entry_exit_returns", lambda s, d: reports.entry_exit_returns(_asked(s, d), bars(s, d), 5).select("ordinal", "ret"), _C3 + " SELECT ordinal, ROUND(ret, 6) AS ret FROM er")
add("d17_regime_accuracy", lambda s, d: reports.regime_accuracy(reports.entry_exit_returns(_asked(s, d), bars(s, d), 5)),
    _C3 + " SELECT regime, COUNT(*) AS n, ROUND(AVG(ret), 6) AS mean_ret, ROUND(AVG(CAST(ret > 0 AS INT)), 6) AS share_up FROM er WHERE ret IS NOT NULL GROUP BY 1")


def _both(s, d):
    rows = view(s, d, "decisions")
    return reports.old_and_new(rows, ranking.consensus(rows.withColumn("day", F.to_date("timestamp"))))


_OLDNEW = duck("decisions") + """, o AS (SELECT CAST(timestamp AS DATE) AS day, symbol, ARG_MAX(action, ordinal) AS old FROM (SELECT * FROM decisions WHERE is_winner QUALIFY ROW_NUMBER() OVER (PARTITION BY CAST(timestamp AS DATE), symbol ORDER BY timestamp DESC, ordinal DESC) = 1) GROUP BY 1, 2),
v AS (SELECT CAST(timestamp AS DATE) AS day, symbol, CASE action WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END AS dir FROM decisions),
g AS (SELECT day, symbol, COALESCE(SUM(dir) / NULLIF(COUNT_IF(dir <> 0), 0), 0) AS score, COUNT_IF(dir <> 0) / COUNT(*) AS part FROM v GROUP BY 1, 2),
c AS (SELECT day, symbol, CASE WHEN ABS(score) * SQRT(part) < 0.15 THEN 'NONE' WHEN score > 0 THEN 'BUY' ELSE 'SELL' END AS new FROM g),
bo AS (SELECT COALESCE(o.day, c.day) AS day, COALESCE(o.symbol, c.symbol) AS symbol, COALESCE(old, '-') AS old, COALESCE(new, '-') AS new FROM o FULL JOIN c ON o.day = c.day AND o.symbol = c.symbol)"""
add("c23_old_and_new_decisions", _both, _OLDNEW + " SELECT day, symbol, old, new FROM bo", ("day",))
add("d25_crosstab", lambda s, d: reports.crosstab(_both(s, d)), _OLDNEW + " SELECT old, new, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM bo GROUP BY 1, 2")
add("c14_aligned_portfolio", lambda s, d: reports.aligned_portfolio(bars(s, d).join(books(s, d), "symbol").select("book", "symbol", "date", "close")),
    duck("bars", "sectors") + f""", {BOOKS}, x AS (SELECT book, symbol, date, close FROM bars JOIN books USING (symbol)), g AS (SELECT * FROM (SELECT DISTINCT book, date FROM x) JOIN (SELECT DISTINCT book, symbol FROM x) USING (book)),
    h AS (SELECT g.book, g.date, LAST_VALUE(close IGNORE NULLS) OVER (PARTITION BY g.book, g.symbol ORDER BY g.date) AS v FROM g LEFT JOIN x ON x.date = g.date AND x.symbol = g.symbol)
    SELECT book, date, ROUND(SUM(v), 6) AS value, COUNT(v) AS n FROM h GROUP BY 1, 2""", ("date",))  # fmt: skip


def _book(s, d):
    return view(s, d, "executions").select("symbol", "ordinal", C("side").alias("action"), C("avg_fill_price").alias("price"), F.when(C("ordinal") % 5 == 0, 0.0).otherwise(1.0).alias("target_qty"))


add("c25_entry_book", lambda s, d: reports.entry_book(_book(s, d)),
    duck("executions") + """, p AS (SELECT symbol, ordinal, side, avg_fill_price AS price, CAST(side = 'SELL' AND ordinal % 5 = 0 AS INT) AS cl FROM executions),
    e AS (SELECT *, COALESCE(SUM(cl) OVER (PARTITION BY symbol ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep, SUM(cl) OVER (PARTITION BY symbol) AS al FROM p)
    SELECT symbol, ROUND(ARG_MIN(price, ordinal), 6) AS entry_price FROM e WHERE ep = al AND side = 'BUY' AND price > 0 GROUP BY 1""")  # fmt: skip
_SH = "ROUND(CASE WHEN COUNT(*) >= 3 THEN (AVG(ret) - 0.04 * AVG(holding_days) / 252) / STDDEV_POP(ret) * SQRT(252 / AVG(holding_days)) END, 12)"
add("d16_drift_alerts", lambda s, d: reports.drift_alerts(trades.trip_metrics(_trips(s, d)).select("agent", "sharpe"), view(s, d, "decisions").select("agent", (C("confidence") * 6).alias("oos_sharpe"))).select("agent", "oos", "sharpe", F.round("gap", 3).alias("gap")),
    TRIPS + f""", l AS (SELECT agent, {_SH} AS sharpe FROM trips GROUP BY 1), w AS (SELECT agent, AVG(confidence * 6) AS oos FROM decisions GROUP BY 1)
    SELECT agent, ROUND(oos, 6) AS oos, ROUND(sharpe, 6) AS sharpe, ROUND(ROUND_EVEN(oos - sharpe, 4), 3) AS gap FROM l JOIN w USING (agent) WHERE ROUND_EVEN(oos - sharpe, 4) > 0.5""")  # fmt: skip
def _matched(s, d):
    rows = risk.daily_returns(bars(s, d)).where("ret IS NOT NULL")
    of = lambda x, r: rows.select(C("symbol").alias(x), "date", C("ret").alias(r))
    return of("a", "r").join(neighbours(s, d), "a").join(of("b", "rb"), ["b", "date"])


add("d21_beta_matched", lambda s, d: reports.beta_matched(_matched(s, d), "a", "b"),
    duck("bars", "sectors") + f""", {PAIRS}, r AS (SELECT symbol, date, close / LAG(close) {_P} - 1 AS ret FROM bars), j AS (SELECT a, b, x.ret AS r, y.ret AS rb FROM pairs JOIN r x ON x.symbol = a JOIN r y ON y.symbol = b AND x.date = y.date WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL),
    e AS (SELECT a, b, REGR_SLOPE(r, rb) AS beta FROM j GROUP BY 1, 2), n AS (SELECT j.*, beta, beta * rb + (1 - beta) * 0.04 / 252 AS naive FROM j JOIN e USING (a, b))
    SELECT a, b, ROUND(ANY_VALUE(beta), 6) AS beta, ROUND(EXP(SUM(LN(1 + r))) - EXP(SUM(LN(1 + naive))), 6) AS excess, ROUND(AVG(r - naive) / STDDEV_SAMP(r - naive) * SQRT(252), 6) AS information_ratio FROM n GROUP BY 1, 2""")  # fmt: skip
_WIN = duck("bars") + f""", i AS (SELECT symbol, date, close, ROW_NUMBER() {_P} - 1 AS i, COUNT(*) OVER (PARTITION BY symbol) AS n FROM bars),
k AS (SELECT symbol, UNNEST(GENERATE_SERIES(0, n - 504, 63)) AS st FROM (SELECT DISTINCT symbol, n FROM i WHERE n >= 504)),
wr AS (SELECT k.symbol, CAST(st / 63 AS INT) AS w, ROUND_EVEN(MAX(close) FILTER (i = st + 503) / MAX(close) FILTER (i = st + 378) - 1, 4) AS r FROM k JOIN i USING (symbol) GROUP BY 1, 2)"""
add("d22_non_overlapping", lambda s, d: reports.non_overlapping(risk.buy_and_hold(risk.walk_forward_windows(bars(s, d)), bars(s, d))),
    _WIN + " SELECT symbol, COUNT(*) AS n, ROUND(EXP(SUM(LN(1 + r))) - 1, 6) AS compound, ROUND(POW(EXP(SUM(LN(1 + r))), 1 / (COUNT(*) * 0.5)) - 1, 6) AS annual, ROUND(QUANTILE_CONT(r, 0.5), 6) AS median FROM wr WHERE w % 2 = 0 GROUP BY 1")
add("d23_best_per_symbol", lambda s, d: reports.best_per_symbol(view(s, d, "decisions").groupBy("symbol", "agent").agg(F.sum("confidence").alias("sharpe"))),
    duck("decisions") + " SELECT symbol, agent, ROUND(s, 6) AS sharpe FROM (SELECT symbol, agent, SUM(confidence) AS s FROM decisions GROUP BY 1, 2) WHERE ABS(s) <= 100 QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ROUND(s, 9) DESC, agent) = 1")
add("d32_plan_allocation", lambda s, d: (lambda t: t.join(F.broadcast(t.agg(F.sum("notional").alias("total")))).orderBy(F.desc("notional"), "symbol").limit(8).select("symbol", "notional", (C("notional") / C("total")).alias("share")))(view(s, d, "executions").groupBy("symbol").agg(F.sum(F.abs(C("qty") * C("limit_price"))).alias("notional"))),
    duck("executions") + " SELECT symbol, ROUND(n, 6) AS notional, ROUND(n / t, 6) AS share FROM (SELECT symbol, SUM(ABS(qty * limit_price)) AS n, SUM(SUM(ABS(qty * limit_price))) OVER () AS t FROM executions GROUP BY 1) ORDER BY n DESC, symbol LIMIT 8")
add("d34_pair_profit", lambda s, d: reports.pair_profit(view(s, d, "executions").select((C("ordinal") % 40).alias("pair"), (C("ordinal") % 2).alias("leg"), F.when(C("ordinal") % 4 < 2, "BUY").otherwise("SELL").alias("side"), F.when(C("side") == "BUY", "open").otherwise("close").alias("event"), C("limit_price").alias("price"), "qty")),
    duck("executions") + """, t AS (SELECT ordinal % 40 AS pair, ordinal % 2 AS leg, CASE WHEN ordinal % 4 < 2 THEN 'BUY' ELSE 'SELL' END AS sd, side = 'BUY' AS op, limit_price AS price, qty FROM executions),
    l AS (SELECT pair, leg, sd, AVG(price) FILTER (op) AS o, AVG(price) FILTER (NOT op) AS c, SUM(qty) FILTER (op) AS q FROM t GROUP BY 1, 2, 3), g AS (SELECT pair, CASE WHEN sd = 'SELL' THEN o - c ELSE c - o END * q AS g FROM l)
    SELECT pair, ROUND(SUM(g), 6) AS pnl, BOOL_OR(g IS NULL) AS incomplete FROM g GROUP BY 1""")  # fmt: skip
add("d35_shadow_outcomes", lambda s, d: reports.shadow_outcomes(_asked(s, d), bars(s, d)),
    duck("bars", "decisions") + _ASK + """, s AS (SELECT symbol, day, action, h, CAST(day + CAST(h + CASE WHEN ISODOW(day) - 1 + h > 4 THEN 2 ELSE 0 END AS INTEGER) AS DATE) AS en FROM ask, (SELECT UNNEST([1, 3, 5]) AS h) WHERE action <> 'HOLD' AND ISODOW(day) < 6),
    p AS (SELECT s.*, b.close AS p0 FROM s ASOF JOIN bars b ON s.symbol = b.symbol AND s.day <= b.date), q AS (SELECT p.*, b.close AS p1 FROM p ASOF JOIN bars b ON p.symbol = b.symbol AND p.en <= b.date)
    SELECT CAST(h AS INT) AS h, COUNT(*) AS n, ROUND(AVG(CAST(CASE WHEN action = 'BUY' THEN p1 / p0 - 1 > 0 ELSE p1 / p0 - 1 < 0 END AS INT)), 6) AS "right", ROUND(AVG(p1 / p0 - 1), 6) AS mean_ret FROM q GROUP BY 1""")  # fmt: skip


def _dividends(s, d):
    rows = bars(s, d).withColumn("r", F.row_number().over(by_symbol())).where("r % 13 = 0")
    return rows.select("symbol", C("date").alias("ex_date"), (0.005 * C("close")).alias("amount"))


_DIV = duck("bars") + f", dv AS (SELECT symbol, date AS ex_date, 0.005 * close AS amount FROM (SELECT *, ROW_NUMBER() {_P} AS r FROM bars) WHERE r % 13 = 0)"
add("d36_dividend_regularity", lambda s, d: reports.dividend_regularity(_dividends(s, d), "2000-06-30"),
    _DIV + """ SELECT symbol, COUNT(*) AS n, ROUND(CASE WHEN COUNT(*) < 2 THEN 0.5 ELSE GREATEST(0, LEAST(1, 1 - STDDEV_POP(amount) / AVG(amount))) END, 6)::DOUBLE AS regularity, MAX(amount) > 2 * AVG(amount) AS special
    FROM dv WHERE ex_date <= DATE '2000-06-30' AND ex_date > DATE '1997-06-30' GROUP BY 1""")  # fmt: skip
add("d39_independent_dates", lambda s, d: reports.independent_dates(bars(s, d).select(C("symbol").alias("agent"), "date")),
    "WITH RECURSIVE " + duck("bars")[5:] + """, dd AS (SELECT symbol AS agent, date, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date) AS k FROM (SELECT DISTINCT symbol, date FROM bars)),
    st AS (SELECT agent, k, date AS last, 1 AS n FROM dd WHERE k = 1 UNION ALL SELECT dd.agent, dd.k, CASE WHEN dd.date - st.last >= 7 THEN dd.date ELSE st.last END, CASE WHEN dd.date - st.last >= 7 THEN st.n + 1 ELSE st.n END FROM st JOIN dd ON dd.agent = st.agent AND dd.k = st.k + 1)
    SELECT agent, CAST(MAX(k) AS INT) AS n_dates, MAX(n) AS n_independent FROM st GROUP BY 1""")  # fmt: skip
add("d41_dividend_trades", lambda s, d: reports.dividend_trades(bars(s, d).where("volume > 40").select("symbol", "date", C("open").alias("entry"), C("close").alias("exit"), C("volume").alias("shares"), F.lit(0.5).alias("dividend"))).groupBy("symbol").agg(F.count("*").alias("n"), F.avg((C("pnl") > 0).cast("double")).alias("win_rate")),
    duck("bars") + " SELECT symbol, COUNT(*) AS n, ROUND(AVG(CAST(ROUND((close - open) * volume + 0.5 * volume * 0.85 - (open + close) * volume * 0.00045, 2) > 0 AS INT)), 6) AS win_rate FROM bars WHERE volume > 40 GROUP BY 1")


def _queue(s, d):
    last = bars(s, d).groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    rows = view(s, d, "decisions").where("action <> 'HOLD'").groupBy("symbol").agg(F.max_by(F.struct("action", "confidence", "ordinal"), "ordinal").alias("x"))
    return rows.join(last, "symbol").select("symbol", "x.action", "x.confidence", "price", (5 + C("x.ordinal") % 300).cast("double").alias("qty"), (C("x.ordinal") % 90).cast("double").alias("held"))


_Q = duck("bars", "decisions") + """, la AS (SELECT symbol, ARG_MAX(close, date) AS price FROM bars GROUP BY 1), de AS (SELECT symbol, action, confidence, ordinal FROM decisions WHERE action <> 'HOLD' QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ordinal DESC) = 1),
q AS (SELECT symbol, action, confidence, price, CAST(5 + ordinal % 300 AS DOUBLE) AS qty, CAST(ordinal % 90 AS DOUBLE) AS held FROM de JOIN la USING (symbol))"""
add("f08_execution_queue", lambda s, d: reports.execution_queue(_queue(s, d), 10_000.0, 15).drop("limit"),
    _Q + """, r AS (SELECT *, action = 'SELL' AND held > 0 AS reducing FROM q), t AS (SELECT *, TRUNC(LEAST(CASE WHEN reducing THEN LEAST(qty, held) ELSE qty END, 10000 / price)) AS sent FROM r),
    p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY reducing ORDER BY confidence DESC, sent * price DESC, symbol) AS place FROM t WHERE sent >= 1)
    SELECT symbol, action, reducing, place, sent, sent <> qty AS adjusted FROM p WHERE reducing OR place <= 15""")  # fmt: skip
add("j02_signed_plans", lambda s, d: reports.signed_plans(_queue(s, d).withColumn("target_weight", F.when(C("action") == "BUY", C("confidence") / 10).otherwise(-C("confidence") / 10)), 1_000_000.0).select("symbol", "action", "target_qty", "delta"),
    _Q + """, t AS (SELECT symbol, held, TRUNC(1000000 * (CASE WHEN action = 'BUY' THEN confidence / 10 ELSE -confidence / 10 END) / price) AS target_qty FROM q)
    SELECT symbol, CASE WHEN ABS(target_qty - held) < 0.5 THEN 'HOLD' WHEN target_qty > held THEN 'BUY' ELSE 'SELL' END AS action, target_qty, target_qty - held AS delta FROM t""")  # fmt: skip
add("f09_top_and_bottom", lambda s, d: (lambda t: t.orderBy(F.desc("total"), "symbol").limit(3).union(t.orderBy("total", "symbol").limit(3)))(bars(s, d).groupBy("symbol").agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("total"))),
    duck("bars") + ", t AS (SELECT symbol, ARG_MAX(close, date) / ARG_MIN(close, date) - 1 AS total FROM bars GROUP BY 1) SELECT symbol, ROUND(total, 6) AS total FROM ((SELECT * FROM t ORDER BY total DESC, symbol LIMIT 3) UNION ALL (SELECT * FROM t ORDER BY total, symbol LIMIT 3))")
add("b11_downsampled_curve", lambda s, d: bars(s, d).withColumn("r", F.row_number().over(by_symbol()) - 1).withColumn("n", F.count("*").over(W.partitionBy("symbol"))).where("r % greatest(1, n div 120) = 0").select("symbol", "date", "close"),
    duck("bars") + f", x AS (SELECT *, ROW_NUMBER() {_P} - 1 AS r, COUNT(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, date, close FROM x WHERE r % GREATEST(1, n // 120) = 0", ("date",))
add("b13_real_fills", lambda s, d: view(s, d, "executions").where("avg_fill_price > 0 AND qty > 1e-9").groupBy("side").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")),
    duck("executions") + " SELECT side, COUNT(*) AS n, SUM(qty) AS qty FROM executions WHERE avg_fill_price > 0 AND qty > 1e-9 GROUP BY 1")
add("g07_equity_points", lambda s, d: bars(s, d).groupBy("date").agg(F.max_by("close", "symbol").alias("v")).agg(F.count("*").alias("n"), (F.max_by("v", "date") / F.min_by("v", "date") - 1).alias("total_return")),
    duck("bars") + ", e AS (SELECT date, ARG_MAX(close, symbol) AS v FROM bars GROUP BY 1) SELECT COUNT(*) AS n, ROUND(ARG_MAX(v, date) / ARG_MIN(v, date) - 1, 6) AS total_return FROM e")
add("g08_idempotent_insert", lambda s, d: (lambda e: e.union(e.where("severity = 'critical'")).dropDuplicates(["id"]).groupBy("severity").agg(F.count("*").alias("n")))(view(s, d, "bus_events")), duck("bus_events") + " SELECT severity, COUNT(DISTINCT id) AS n FROM bus_events GROUP BY 1")
add("h11_kelly_scale", lambda s, d: view(s, d, "decisions").select("ordinal", reports.kelly_scale(F.create_map(F.lit("bull"), C("confidence"), F.lit("bear"), 1 - C("confidence")), {"bull": 1.0, "choppy": 0.5, "bear": 0.25}).alias("scale")),
    duck("decisions") + " SELECT ordinal, ROUND(confidence + 0.25 * (1 - confidence), 6) AS scale FROM decisions")
add("f06_normalized_confidence", lambda s, d: (lambda t: ranking.normalize_confidence(t, t.groupBy("agent").agg(F.percentile("confidence", F.lit(0.1)).alias("lo"), F.percentile("confidence", F.lit(0.9)).alias("hi"))).select("ordinal", "confidence"))(view(s, d, "decisions")),
    duck("decisions") + ", r AS (SELECT agent, QUANTILE_CONT(confidence, 0.1) AS lo, QUANTILE_CONT(confidence, 0.9) AS hi FROM decisions GROUP BY 1) SELECT ordinal, ROUND(CASE WHEN hi > lo THEN GREATEST(0, LEAST(1, (confidence - lo) / (hi - lo))) ELSE confidence END, 6)::DOUBLE AS confidence FROM decisions JOIN r USING (agent)")
add("e20_daily_from_windows", lambda s, d: reports.daily_from_windows(risk.buy_and_hold(risk.walk_forward_windows(bars(s, d)), bars(s, d)).join(risk.walk_forward_windows(bars(s, d)), ["symbol", "window"]).select(C("symbol").alias("agent"), C("test_start").alias("start"), C("test_end").alias("end"), C("asset_return").alias("ret"))).groupBy("agent").agg(F.count("*").alias("n_days"), F.avg("ret").alias("mean_ret")),
    WALK_FORWARD + """, ar AS (SELECT wf.symbol, wf."window", test_start AS a, test_end AS z, ROUND_EVEN(ARG_MAX(close, date) / ARG_MIN(close, date) - 1, 4) AS ret FROM wf JOIN bars b ON wf.symbol = b.symbol AND date BETWEEN test_start AND test_end GROUP BY ALL),
    dy AS (SELECT symbol, "window", ret, CAST(UNNEST(GENERATE_SERIES(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM ar), wk AS (SELECT *, COUNT(*) OVER (PARTITION BY symbol, "window") AS n FROM dy WHERE ISODOW(date) < 6),
    m AS (SELECT symbol, date, AVG(POW(1 + ret, 1 / n) - 1) AS r FROM wk GROUP BY 1, 2) SELECT symbol AS agent, COUNT(*) AS n_days, ROUND(AVG(r), 6) AS mean_ret FROM m GROUP BY 1""")  # fmt: skip

