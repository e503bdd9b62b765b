"""Dividend, macro, volatility-index and pair rules, alerts, leaderboards and smaller helpers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.ranks import numbered
from quantpanel.operators import dividends, features, logs, regimes, reports, risk, strategies, trades
from quantpanel.sources.scratch import written

from .common import Catalog, back, duck, guarded, view
from .feature_queries import CATALOG as FEATURES
from .log_queries import _CAT, TRIPS, _trips
from .signal_queries import RULES

CATALOG = Catalog()
add = CATALOG.add
C = F.col


def bars(s, d):
    return view(s, d, "bars")


def _payments(s, d):
    """Upcoming payments, derived from the bars."""
    v = C("volume").cast("int")
    return bars(s, d).select(
        "symbol", "date", (v % 40 - 5).alias("days_to_ex"), (0.1 + (v % 9) / 10.0).alias("amount"), C("close").alias("price"), ((v % 11) / 10.0).alias("regularity"), (v % 7 == 0).alias("special"),
        (C("volume") / 25.0).alias("vol_ratio"), (v % 5 == 0).alias("mispriced"), risk.dividend_net_edge((0.1 + (v % 9) / 10.0) / C("close"), F.lit(9.0), F.lit(0.0005)).alias("net_edge"), (v % 3 == 0).alias("held"), C("open").alias("entry_price"),
    )


_PAY = duck("bars") + """, raw AS (SELECT *, CAST(volume AS INT) AS v FROM bars),
pay AS (SELECT symbol, date, v % 40 - 5 AS days_to_ex, 0.1::DOUBLE + (v % 9) / 10.0::DOUBLE AS amount, close AS price, (v % 11) / 10.0::DOUBLE AS regularity, v % 7 = 0 AS special, volume / 25.0::DOUBLE AS vol_ratio, v % 5 = 0 AS mispriced,
        (0.1::DOUBLE + (v % 9) / 10.0::DOUBLE) / close * 0.85 - 0.04 * 9 / 365 - 0.0009 - 0.5 * 1.645 * 0.0005 * SQRT(9.0::DOUBLE) AS net_edge, v % 3 = 0 AS held, open AS entry_price FROM raw),
pc AS (SELECT *, amount / price AS y, ROUND(LEAST(1.0, CASE WHEN net_edge > 0 THEN 0.30 ELSE 0 END + LEAST(0.20, regularity * 0.20) + CASE WHEN days_to_ex BETWEEN 3 AND 7 THEN 0.15 ELSE 0 END + CASE WHEN special THEN 0 ELSE 0.15 END
       + CASE WHEN vol_ratio > 1 THEN 0.10 ELSE 0 END + CASE WHEN mispriced THEN 0.10 ELSE 0 END), 4)::DOUBLE AS confidence FROM pay)"""
add("h08_dividend_confidence", lambda s, d: _payments(s, d).select("symbol", "date", dividends.confidence().alias("confidence")), _PAY + " SELECT symbol, date, confidence FROM pc", ("date",))
add("i10_dividend_capture", lambda s, d: dividends.capture_signals(_payments(s, d)).select("symbol", "date", "action", "reason", "confidence", "target_weight"),
    _PAY + """, r AS (SELECT *, CASE WHEN held THEN CASE WHEN days_to_ex <= -1 THEN 'after' WHEN price > entry_price + 1.5 * amount THEN 'profit' WHEN price < entry_price - 2 * amount THEN 'stop' END END AS reason FROM pc),
    a AS (SELECT *, CASE WHEN held AND reason IS NOT NULL THEN 'SELL' WHEN NOT held AND days_to_ex BETWEEN 2 AND 7 AND y >= 0.003 AND net_edge > 0 AND confidence >= 0.5 THEN 'BUY' ELSE 'HOLD' END AS action FROM r)
    SELECT symbol, date, action, reason, confidence, CASE WHEN action = 'BUY' THEN 0.08 ELSE 0 END::DOUBLE AS target_weight FROM a""", ("date",))  # fmt: skip
add("i11_dividend_window", lambda s, d: dividends.window_signals(_payments(s, d)).select("symbol", "date", "action", "confidence"),
    _PAY + """, a AS (SELECT *, CASE WHEN held AND days_to_ex < 0 THEN 'SELL' WHEN NOT held AND days_to_ex > 0 AND days_to_ex <= 3 AND y >= 0.003 THEN 'BUY' ELSE 'HOLD' END AS action FROM pc)
    SELECT symbol, date, action, ROUND(CASE action WHEN 'SELL' THEN 0.90 WHEN 'BUY' THEN LEAST(0.85, 0.60 + 50 * y) ELSE 0.2 END, 6)::DOUBLE AS confidence FROM a""", ("date",))  # fmt: skip
add("f11_dividend_calendar", lambda s, d: dividends.calendar(_payments(s, d)).select("symbol", "date", "days_to_ex", "edge", "active").orderBy("days_to_ex", "symbol", "date"),
    _PAY + " SELECT symbol, date, days_to_ex, ROUND(10000 * net_edge, 6) AS edge, days_to_ex BETWEEN 2 AND 7 AS active FROM pay WHERE days_to_ex BETWEEN 0 AND 30", ("date",))


def _macro(s, d):
    """Indicators by day of the year; one is missing now and then."""
    doy = F.dayofyear("date")
    return bars(s, d).select("date").distinct().select("date", ((doy % 30) / 10.0 - 1).alias("yield_curve"), F.when(doy % 17 != 0, (250 + doy % 400).cast("double")).alias("hy_spread"), (10 + doy % 30).cast("double").alias("vix"), ((doy % 20) / 10.0 - 1).alias("fed_trend"))


_MACRO = duck("bars") + """, dd AS (SELECT DISTINCT date, DAYOFYEAR(date) AS doy FROM bars), mi AS (SELECT date, (doy % 30) / 10.0::DOUBLE - 1 AS c, CASE WHEN doy % 17 <> 0 THEN 250 + doy % 400 END AS h, 10 + doy % 30 AS x, (doy % 20) / 10.0::DOUBLE - 1 AS f FROM dd),
mp AS (SELECT date, CASE WHEN c > 1.0 THEN 2 WHEN c > 0.5 THEN 1 ELSE 0 END + CASE WHEN h < 300 THEN 2 WHEN h < 380 THEN 1 ELSE 0 END + CASE WHEN x < 15 THEN 1 ELSE 0 END + CASE WHEN f < -0.5 THEN 1 ELSE 0 END AS risk_on,
       CASE WHEN c < -0.25 THEN 2 WHEN c < 0 THEN 1 ELSE 0 END + CASE WHEN h > 600 THEN 2 WHEN h > 450 THEN 1 ELSE 0 END + CASE WHEN x > 30 THEN 2 WHEN x > 23 THEN 1 ELSE 0 END + CASE WHEN f > 0.75 THEN 1 ELSE 0 END AS risk_off FROM mi)"""
add("h09_macro_points", lambda s, d: strategies.macro_points(_macro(s, d)).select("date", "risk_on", "risk_off"), _MACRO + " SELECT date, risk_on, risk_off FROM mp", ("date",))


def _proxied(s, d):
    """Three symbols stand for the funds; in even months no indicator is known."""
    even = F.month("date") % 2 == 0
    rows = _macro(s, d)
    rows = rows.select("date", *(F.when(~even, C(c)).alias(c) for c in strategies.INDICATORS))
    role = F.when(C("symbol") == "S1", "equity").when(C("symbol") == "S2", "gold").when(C("symbol") == "S3", "bonds")
    return strategies.macro_or_fund_points(rows, bars(s, d).select(role.alias("role"), "date", "close").where("role IS NOT NULL"))


add("i07_fund_fallback", lambda s, d: _proxied(s, d).select("date", "risk_on", "risk_off", "source"),
    _MACRO + """, fm AS (SELECT symbol, date, CASE WHEN ROW_NUMBER() OVER w > 63 THEN close / LAG(close, 62) OVER w - 1 ELSE 0 END AS m FROM bars WHERE symbol IN ('S1', 'S2', 'S3') WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    fd AS (SELECT mp.date, COALESCE((SELECT ARG_MAX(m, fm.date) FROM fm WHERE symbol = 'S1' AND fm.date <= mp.date), 0) AS e, COALESCE((SELECT ARG_MAX(m, fm.date) FROM fm WHERE symbol = 'S2' AND fm.date <= mp.date), 0) AS g, COALESCE((SELECT ARG_MAX(m, fm.date) FROM fm WHERE symbol = 'S3' AND fm.date <= mp.date), 0) AS b FROM mp)
    SELECT date, CASE WHEN MONTH(date) % 2 = 1 THEN risk_on ELSE CASE WHEN e > 0.05 THEN 2 ELSE 0 END + CASE WHEN g < 0 THEN 1 ELSE 0 END + CASE WHEN b < -0.03 THEN 1 ELSE 0 END END AS risk_on,
    CASE WHEN MONTH(date) % 2 = 1 THEN risk_off ELSE CASE WHEN e < -0.05 THEN 2 ELSE 0 END + CASE WHEN g > 0.05 THEN 1 ELSE 0 END + CASE WHEN b > 0.03 THEN 1 ELSE 0 END END AS risk_off, CASE WHEN MONTH(date) % 2 = 1 THEN 'indicators' ELSE 'funds' END AS source FROM mp JOIN fd USING (date)""", ("date",))  # fmt: skip


def _confirmed(s, d):
    mom = C("close") / F.lag("close", 63).over(W.partitionBy("symbol").orderBy("date")) - 1
    rows = bars(s, d).select("symbol", "date", F.coalesce(mom, F.lit(0.0)).alias("mom63"), F.when(C("volume").cast("int") % 3 == 0, "bear").otherwise("bull").alias("regime"), (C("volume").cast("int") % 2 == 0).alias("held"))
    return strategies.macro_signal(rows.join(strategies.macro_points(_macro(s, d)), "date"))


add("i07_macro_signal", lambda s, d: _confirmed(s, d).select("symbol", "date", "action", "confidence", "target_weight"),
    _MACRO + f""", t AS (SELECT symbol, date, COALESCE(close / {back('close', 63)} - 1, 0) AS mom, CAST(volume AS INT) AS v FROM bars), a AS (SELECT *, CASE WHEN v % 2 = 0 AND risk_off >= 4 AND mom < -0.02 THEN 'SELL' WHEN risk_on >= 4 AND v % 3 <> 0 AND mom > 0.02 THEN 'BUY' ELSE 'HOLD' END AS action FROM t JOIN mp USING (date))
    SELECT symbol, date, action, CASE action WHEN 'SELL' THEN 0.8 WHEN 'BUY' THEN LEAST(0.85, 0.60 + CASE WHEN risk_on >= 6 THEN 0.10 ELSE 0 END) ELSE 0.4 END::DOUBLE AS confidence, CASE WHEN action = 'BUY' THEN 0.05 ELSE 0 END::DOUBLE AS target_weight FROM a""", ("date",))  # fmt: skip
add("i06_volatility_extremes", lambda s, d: strategies.volatility_index_signal(FEATURES.queries["e15_index_extremes"](s, d).withColumn("date", F.to_date("date")).join(bars(s, d).select("symbol", "date", (C("close") / 4).alias("close"), (C("volume").cast("int") % 2 == 0).alias("held")), ["symbol", "date"])).select("symbol", "date", "action", "confidence", "target_weight"),
    f"WITH e AS ({FEATURES.sql['e15_index_extremes']}), {duck('bars')[5:]}" + """, x AS (SELECT b.symbol, b.date, b.close / 4 AS c, CAST(volume AS INT) % 2 = 0 AS held, vix_z AS z, vix_mom5 AS m, vix_ratio AS r FROM bars b JOIN e ON e.symbol = b.symbol AND e.date = CAST(b.date AS VARCHAR)),
    k AS (SELECT *, CASE WHEN held AND (m > 0.20 OR r > 1.40) THEN 1 WHEN held AND c < 15 AND z < -1.5 THEN 2 WHEN NOT held AND c > 35 AND z > 1.5 THEN 3 WHEN NOT held AND c > 25 AND z > 0.8 AND m < 0.05 THEN 4 ELSE 5 END AS k FROM x)
    SELECT symbol, date, CASE WHEN k < 3 THEN 'SELL' WHEN k < 5 THEN 'BUY' ELSE 'HOLD' END AS action, ROUND(CASE k WHEN 1 THEN 0.85 WHEN 2 THEN 0.70 WHEN 3 THEN 0.88 WHEN 4 THEN LEAST(0.82, 0.60 + (c - 25) * 0.01) ELSE 0.3 END, 6)::DOUBLE AS confidence,
    CASE k WHEN 3 THEN 0.10 WHEN 4 THEN 0.08 ELSE 0 END::DOUBLE AS target_weight FROM k""", ("date",))  # fmt: skip
add("i14_scored_news", lambda s, d: strategies.scored_news_signal(view(s, d, "decisions").select("ordinal", "action", "confidence")),
    duck("decisions") + ", a AS (SELECT ordinal, CASE WHEN confidence < 0.55 THEN 'HOLD' ELSE action END AS action, confidence FROM decisions) SELECT ordinal, action, confidence, CASE WHEN action = 'BUY' THEN 0.10 ELSE 0 END::DOUBLE AS target_weight FROM a")
add("h06_slippage", lambda s, d: view(s, d, "executions").groupBy("side").agg(F.avg(trades.slippage_bps(C("side"), C("avg_fill_price"), C("limit_price"))).alias("mean_bps"), F.count("*").alias("n")),
    duck("executions") + " SELECT side, ROUND(AVG(CASE WHEN avg_fill_price <= 0 OR limit_price <= 0 THEN 0 ELSE (avg_fill_price - limit_price) / limit_price * 10000 * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END END), 6) AS mean_bps, COUNT(*) AS n FROM executions GROUP BY 1")
add("h12_kelly_blend", lambda s, d: view(s, d, "decisions").groupBy("agent", "symbol").agg(F.avg("target_weight").alias("live"), F.avg("confidence").alias("fallback"), F.count("*").alias("n")).select("agent", "symbol", risk.kelly_blend(C("live"), C("fallback"), C("n")).alias("weight")),
    duck("decisions") + " SELECT agent, symbol, ROUND(LEAST(1, COUNT(*) / 20) * AVG(target_weight) + (1 - LEAST(1, COUNT(*) / 20)) * AVG(confidence), 6)::DOUBLE AS weight FROM decisions GROUP BY 1, 2")
add("h13_period_returns", lambda s, d: bars(s, d).groupBy("symbol").agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("r"), F.count("*").cast("double").alias("n")).select("symbol", risk.annual_return(C("r"), C("n")).alias("annual"), risk.daily_return(C("r"), C("n")).alias("daily")),
    duck("bars") + ", r AS (SELECT symbol, ARG_MAX(close, date) / ARG_MIN(close, date) AS g, COUNT(*) AS n FROM bars GROUP BY 1) SELECT symbol, ROUND(POW(g, 252 / n) - 1, 6) AS annual, ROUND(POW(g, 1 / n) - 1, 6) AS daily FROM r")
add("d19_sharpe_variants", lambda s, d: risk.sharpe_variants(bars(s, d)),
    duck("bars") + f""", r AS (SELECT symbol, close / {back('close', 1)} - 1 AS r, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars),
    q AS (SELECT symbol, (AVG(r) - 0.04 / 252) / NULLIF(STDDEV_SAMP(r), 0) * SQRT(252) AS s, (AVG(r) FILTER (k < 126) - 0.04 / 252) / NULLIF(STDDEV_SAMP(r) FILTER (k < 126), 0) * SQRT(252) AS t, COUNT(r) AS n, COUNT(r) FILTER (k < 126) AS m FROM r GROUP BY 1)
    SELECT symbol, ROUND(CASE WHEN ABS(s) <= 100 THEN s ELSE 0 END, 6)::DOUBLE AS engine, ROUND(CASE WHEN n >= 5 THEN COALESCE(GREATEST(-50, LEAST(50, s)), 0) ELSE 0 END, 3)::DOUBLE AS portfolio, ROUND(CASE WHEN m >= 5 THEN COALESCE(GREATEST(-500, LEAST(500, t)), 0) ELSE 0 END, 6)::DOUBLE AS allocator FROM q""")  # fmt: skip


def _blend(s, d):
    rows = view(s, d, "decisions")
    return risk.blended_best(rows.groupBy("agent", "symbol").agg(F.avg("confidence").alias("sharpe")), rows.where("action = 'BUY'").groupBy("agent", "symbol").agg(F.avg("target_weight").alias("live"), F.count("*").alias("n")))


add("d30_blended_best", lambda s, d: _blend(s, d).select("agent", "symbol", "blended", "best"),
    duck("decisions") + """, b AS (SELECT agent, symbol, AVG(confidence) AS bt, AVG(target_weight) FILTER (action = 'BUY') AS live, COUNT(*) FILTER (action = 'BUY') AS n FROM decisions GROUP BY 1, 2),
    m AS (SELECT agent, symbol, ROUND(CAST(CASE WHEN live IS NULL THEN bt ELSE (1 - LEAST(1, n / 20)) * bt + LEAST(1, n / 20) * live END AS DECIMAL(18, 9)), 4)::DOUBLE AS blended FROM b) SELECT agent, symbol, blended, FIRST_VALUE(agent) OVER (PARTITION BY symbol ORDER BY blended DESC, agent) AS best FROM m""")  # fmt: skip
add("e21_daily_from_trips", lambda s, d: reports.daily_from_trips(_trips(s, d).select("agent", F.to_date("entry_ts").alias("entry"), F.to_date("exit_ts").alias("exit"), "ret")),
    TRIPS + """, t AS (SELECT agent, CAST(entry_ts AS DATE) AS e, CAST(exit_ts AS DATE) AS x, ret FROM trips), days AS (SELECT agent, CAST(UNNEST(GENERATE_SERIES(MIN(e)::TIMESTAMP, MAX(x)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM t GROUP BY 1),
    k AS (SELECT agent, x AS date, AVG(ret) AS ret FROM t GROUP BY 1, 2) SELECT agent, date, ROUND(COALESCE(ret, 0), 6) AS ret FROM days LEFT JOIN k USING (agent, date) WHERE ISODOW(date) < 6""", ("date",))  # fmt: skip
add("f12_leaderboard", lambda s, d: numbered(bars(s, d).groupBy("symbol").agg(F.round(F.max_by("close", "date") / F.min_by("close", "date") - 1, 6).alias("ret")), [F.desc("ret"), "symbol"]),
    duck("bars") + ", r AS (SELECT symbol, ROUND(ARG_MAX(close, date) / ARG_MIN(close, date) - 1, 6) AS ret FROM bars GROUP BY 1) SELECT symbol, ret, ROW_NUMBER() OVER (ORDER BY ret DESC, symbol) AS place FROM r")
add("b10_intraday_alerts", lambda s, d: logs.intraday_alerts(view(s, d, "news").withColumn("category", logs.headline_category(C("headline"), F.when(C("ordinal") % 4 == 0, "merger news").when(C("ordinal") % 4 == 1, "earnings"))), trades.net_positions(view(s, d, "executions"))).select("ordinal", "ticker", "category"),
    duck("news", "executions") + f""", c AS (SELECT ordinal, ticker, {_CAT} AS category FROM (SELECT ordinal, ticker, ' ' || LOWER(headline) || ' ' AS h, CASE ordinal % 4 WHEN 0 THEN 'merger news' WHEN 1 THEN 'earnings' END AS native_category FROM news)),
    p AS (SELECT symbol FROM executions GROUP BY 1 HAVING ABS(SUM(CASE WHEN side = 'BUY' THEN qty ELSE -qty END)) > 1e-6) SELECT ordinal, ticker, category FROM c WHERE category IN ('earnings', 'ma') AND ticker IN (SELECT symbol FROM p)""")  # fmt: skip
add("b12_unreadable_timestamps", lambda s, d: logs.parsed_times(view(s, d, "decisions").select("agent", F.when(C("ordinal") % 9 == 0, "soon").otherwise(C("timestamp").cast("string")).alias("timestamp")), "timestamp", "agent")[1],
    duck("decisions") + " SELECT agent, COUNT(*) AS n_dropped FROM decisions WHERE ordinal % 9 = 0 GROUP BY 1")
add("k02_degraded_runs", lambda s, d: logs.degraded_runs(view(s, d, "decisions").where("action = 'HOLD'"), 7, runs=view(s, d, "decisions")),
    duck("decisions") + " SELECT plan_id, COUNT(DISTINCT CASE WHEN action = 'HOLD' THEN agent END) AS responders, COUNT(DISTINCT CASE WHEN action = 'HOLD' THEN agent END) < GREATEST(1, CEIL(7 * 0.5)) AS degraded FROM decisions GROUP BY 1")


def _odd_volume(rows):
    """A rule that has no answer for some rows."""
    if (rows["volume"] % 47 == 0).any():
        raise ValueError("volume is a multiple of 47")
    return rows.assign(action="HOLD", confidence=0.5, target_weight=0.0)


def _isolated(s, d):
    """What all rules say of each row, one that fails on some rows, one that says so itself and one that cannot be planned among them."""
    own = [
        strategies.Strategy("odd_volume", 1, lambda: strategies.guarded(_odd_volume, "volume")),
        strategies.Strategy("shy", 30, lambda: F.when(C("volume") % 5 == 0, strategies.failure(F.concat(F.lit("no answer on "), C("symbol")))).otherwise(strategies.decision("HOLD", 0.1))),
        strategies.Strategy("misspelt", 100, lambda: strategies.decision("BUY", C("no_such_feature"))),
    ]
    return strategies.decided(features.features(bars(s, d), ()), [*RULES, *own])


def _responders(rows):
    """A row per symbol and date, which are the runs: how many of the eight rules answered. Written for the short methods of its write."""
    return written(rows.select("symbol", "date", sum((strategies.answered(k).cast("long") for k in range(8)), F.lit(0)).alias("responders")), "responders")


def _failed(rows):
    """Failures by rule and error. Planning fails with one text for all rows, so the name that is missing is found in the summary. Written for the short methods of its write."""
    found = written(logs.failure_summary(strategies.unfolded(rows).where("error IS NOT NULL")), "failures")
    return found.withColumn("error", F.when(C("agent") == "misspelt", F.regexp_extract("error", r"(no_such_feature)", 1)).otherwise(C("error")))


_N = duck("bars") + ", n AS (SELECT symbol, date, CAST(volume AS INT) AS v, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars)"
_HEALTHY = " + ".join(f"CAST(n >= {r[0]} AS INT)" for r in RULES.values()) + " + CAST(v % 47 <> 0 AS INT) + CAST(n >= 30 AND v % 5 <> 0 AS INT)"
add("k02_isolated_runs", lambda s, d: logs.judged_runs(_responders(_isolated(s, d)), 8),
    _N + f", h AS (SELECT symbol, date, CAST({_HEALTHY} AS BIGINT) AS responders FROM n) SELECT symbol, date, responders, responders < 4 AS degraded FROM h", ("date",))
add("k02_isolated_failures", lambda s, d: _failed(_isolated(s, d)),
    _N + """, f AS (SELECT 'odd_volume' AS agent, 'ValueError: volume is a multiple of 47' AS error, symbol FROM n WHERE v % 47 = 0 UNION ALL SELECT 'shy', 'no answer on ' || symbol, symbol FROM n WHERE n >= 30 AND v % 5 = 0 UNION ALL SELECT 'misspelt', 'no_such_feature', symbol FROM n WHERE n >= 100)
    SELECT agent, error, COUNT(DISTINCT symbol) AS symbols, COUNT(*) AS n FROM f GROUP BY 1, 2""")  # fmt: skip
add("k02_failure_summary", lambda s, d: logs.failure_summary(view(s, d, "decisions").where("action = 'SELL'").select("agent", C("regime").alias("error"), "symbol")),
    duck("decisions") + " SELECT agent, regime AS error, COUNT(DISTINCT symbol) AS symbols, COUNT(*) AS n FROM decisions WHERE action = 'SELL' GROUP BY 1, 2")


def _neighbours(s, d):
    """Each symbol and the next one of its sector."""
    names = view(s, d, "sectors").withColumn("k", F.substring("ticker", 2, 9).cast("int"))
    return names.select(C("ticker").alias("a"), F.lead("ticker").over(W.partitionBy("sector").orderBy("k")).alias("b"), F.lit(0.5).alias("beta"), (C("k") % 3).alias("extra")).where("b IS NOT NULL")


def _breaking(s, d):
    """Every third pair is cointegrated until the middle of 1996 only."""
    return _neighbours(s, d).withColumn("active_until", F.when(C("extra") == 2, F.lit("1996-06-30").cast("date")))


# the state goes from row to row; nothing is shared with the windows of the operator
add("i12_pair_signals", lambda s, d: risk.pair_signals(bars(s, d), _breaking(s, d)),
    "WITH RECURSIVE " + duck("bars", "sectors")[5:] + """, pr AS (SELECT ticker AS a, LEAD(ticker) OVER (PARTITION BY sector ORDER BY CAST(SUBSTR(ticker, 2) AS INT)) AS b, CAST(SUBSTR(ticker, 2) AS INT) % 3 AS extra FROM sectors),
    j AS (SELECT a, b, extra, x.date, LN(x.close) - 0.5 * LN(y.close) AS s FROM pr JOIN bars x ON x.symbol = a JOIN bars y ON y.symbol = b AND y.date = x.date), w AS (SELECT *, COUNT(s) OVER v AS n, AVG(s) OVER v AS m, STDDEV_SAMP(s) OVER v AS sd FROM j WINDOW v AS (PARTITION BY a, b ORDER BY date ROWS 62 PRECEDING)),
    z AS (SELECT a, b, extra, date, (s - m) / sd AS z, extra = 2 AND date > DATE '1996-06-30' AS gone, ROW_NUMBER() OVER (PARTITION BY a, b ORDER BY date) AS k FROM w WHERE n = 63 AND sd >= 1e-6),
    st AS (SELECT a, b, CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS date, CAST(0 AS DOUBLE) AS z, FALSE AS held, '' AS action, CAST(NULL AS VARCHAR) AS side, CAST(NULL AS VARCHAR) AS shown, 0 AS extra FROM (SELECT DISTINCT a, b FROM z)
      UNION ALL SELECT z.a, z.b, z.k, z.date, z.z, st.side IS NOT NULL,
        CASE WHEN st.side IS NOT NULL THEN CASE WHEN gone THEN 'BREAK' WHEN ABS(z.z) > 3.5 THEN 'STOP' WHEN ABS(z.z) < 0.5 THEN 'EXIT' ELSE 'HOLD' END WHEN NOT gone AND ABS(z.z) > 2 THEN 'ENTER' ELSE 'HOLD' END,
        CASE WHEN st.side IS NOT NULL THEN CASE WHEN gone OR ABS(z.z) > 3.5 OR ABS(z.z) < 0.5 THEN NULL ELSE st.side END WHEN NOT gone AND z.z > 2 THEN 'SELL' WHEN NOT gone AND z.z < -2 THEN 'BUY' END,
        CASE WHEN st.side IS NOT NULL THEN st.side WHEN NOT gone AND z.z > 2 THEN 'SELL' WHEN NOT gone AND z.z < -2 THEN 'BUY' END, z.extra
      FROM st JOIN z ON z.a = st.a AND z.b = st.b AND z.k = st.k + 1)
    SELECT a, b, date, ROUND(z, 6) AS z, held, action, CASE action WHEN 'ENTER' THEN ROUND(LEAST(0.93, LEAST(0.90, 0.60 + 0.1 * (ABS(z) - 2)) + 0.03 * extra), 3) WHEN 'BREAK' THEN 0.99 WHEN 'STOP' THEN 0.98 WHEN 'EXIT' THEN 0.90 ELSE 0 END::DOUBLE AS confidence,
    shown AS side_a, CASE shown WHEN 'SELL' THEN 'BUY' WHEN 'BUY' THEN 'SELL' END AS side_b FROM st WHERE k > 0""", ("date",))  # fmt: skip
add("j03_pair_plans", lambda s, d: reports.pair_plans(_neighbours(s, d).select("a", "b", F.when(C("extra") == 0, "BUY").otherwise("SELL").alias("side")), bars(s, d).groupBy("symbol").agg((F.max_by("close", "date") * F.when(F.substring("symbol", 2, 9).cast("int") % 4 == 0, 200.0).otherwise(1.0)).alias("price")), 10_000.0).select("a", "b", "symbol", "leg_side", C("qty").cast("double").alias("qty")),
    duck("bars", "sectors") + """, pr AS (SELECT ticker AS a, LEAD(ticker) OVER (PARTITION BY sector ORDER BY CAST(SUBSTR(ticker, 2) AS INT)) AS b, CAST(SUBSTR(ticker, 2) AS INT) % 3 AS extra FROM sectors), px AS (SELECT symbol, ARG_MAX(close, date) * CASE WHEN CAST(SUBSTR(symbol, 2) AS INT) % 4 = 0 THEN 200.0 ELSE 1.0 END AS price FROM bars GROUP BY 1),
    l AS (SELECT a, b, a AS symbol, CASE WHEN extra = 0 THEN 'BUY' ELSE 'SELL' END AS leg_side FROM pr WHERE b IS NOT NULL UNION ALL SELECT a, b, b, CASE WHEN extra = 0 THEN 'SELL' ELSE 'BUY' END FROM pr WHERE b IS NOT NULL), q AS (SELECT l.*, TRUNC(10000 / price)::DOUBLE AS qty FROM l LEFT JOIN px USING (symbol))
    SELECT a, b, symbol, leg_side, qty FROM q QUALIFY COUNT(*) FILTER (qty >= 1) OVER (PARTITION BY a, b) = 2""")  # fmt: skip


def _chain(s, d):
    """Option chains, derived from the bars: three strikes for each day, a call and a put each."""
    rows = bars(s, d).select(C("symbol").alias("ticker"), C("date").alias("expiry"), C("close").alias("spot"), (C("volume").cast("int") % 60).alias("days"), F.explode(F.array(F.lit(-5.0), F.lit(1.0), F.lit(5.0))).alias("off"))
    rows = rows.select("*", F.round(C("spot") + C("off"), 2).alias("strike"), F.explode(F.array(F.lit("C"), F.lit("P"))).alias("right"))
    worth = F.when(C("right") == "C", F.greatest(F.lit(0.0), -C("off"))).otherwise(F.greatest(F.lit(0.0), C("off"))) + C("days") / 50.0
    return rows.select("ticker", "expiry", "strike", "right", worth.alias("last_price"), "spot", "days", F.lit(0.4).alias("dividend"))


add("c24_put_call_flags", lambda s, d: reports.put_call_flags(_chain(s, d)).select("ticker", "expiry", "strike", "gap", "flag"),
    duck("bars") + """, k AS (SELECT symbol AS ticker, date AS expiry, close AS spot, CAST(volume AS INT) % 60 AS days, ROUND(close + 1.0::DOUBLE, 2) AS strike FROM bars), g AS (SELECT *, ABS((0 + days / 50.0::DOUBLE) - (1.0::DOUBLE + days / 50.0::DOUBLE) - (spot - strike * EXP(-0.04::DOUBLE * GREATEST(days / 365.0::DOUBLE, 1 / 365.0::DOUBLE)) - 0.4::DOUBLE)) / spot AS gap FROM k)
    SELECT ticker, expiry, strike, ROUND(gap, 6) AS gap, gap > 0.005 AS flag FROM g""", ("expiry",))  # fmt: skip


FEATURES_SQL = duck("bars") + f""", r1 AS (SELECT *, close / {back('close', 1)} - 1 AS ret1, GREATEST(high - low, ABS(high - {back('close', 1)}), ABS(low - {back('close', 1)})) AS tr FROM bars),
m1 AS (SELECT symbol, date, {guarded('STDDEV_SAMP', 'ret1', 5)} AS v5, ({guarded('STDDEV_SAMP', 'ret1', 21)}) * SQRT(252) AS v21, close / {back('close', 10)} - 1 AS m10, close / {back('close', 30)} - 1 AS m30, {guarded('SUM', 'ret1', 21)} AS r21, {guarded('AVG', 'tr', 14)} AS atr FROM r1),
mx AS (SELECT * REPLACE (ROUND(r21, 9) AS r21) FROM m1 WHERE v5 IS NOT NULL AND v21 IS NOT NULL AND m10 IS NOT NULL AND m30 IS NOT NULL AND r21 IS NOT NULL AND atr IS NOT NULL)"""


def _matrix(s, d):
    return features.regime_matrix(features.volatility(features.average_true_range(bars(s, d))))


def _regimes(s, d):
    matrix = written(_matrix(s, d), "regime-matrix")
    return regimes.regime_series(bars(s, d), regimes.regime_posteriors(regimes.fit_regimes(matrix), matrix))


# the fit has no SQL; the naming of components has, on the means of four groups of each symbol's rows
add("i15_regime_clusters", _regimes)
add("i15_component_names", lambda s, d: regimes.name_components(_matrix(s, d).withColumn("component", F.ntile(4).over(W.partitionBy("symbol").orderBy(F.round("ret_21d", 9), "date"))).groupBy("symbol", "component").agg(F.round(F.avg("mom_30d"), 9).alias("mom_30d"), F.round(F.avg("vol_21d"), 9).alias("vol_21d")), ("symbol",)),
    FEATURES_SQL + """, g AS (SELECT symbol, NTILE(4) OVER (PARTITION BY symbol ORDER BY r21, date) AS component, m30, v21 FROM mx), c AS (SELECT symbol, CAST(component AS INT) AS component, ROUND(AVG(m30), 9) AS mom_30d, ROUND(AVG(v21), 9) AS vol_21d FROM g GROUP BY 1, 2),
    low AS (SELECT *, RANK() OVER (PARTITION BY symbol ORDER BY mom_30d, component) <= 2 AS low FROM c), o AS (SELECT l.*, (SELECT MAX((m.vol_21d, -m.component)) FROM low m WHERE m.symbol = l.symbol AND m.low = l.low) = (l.vol_21d, -l.component) AS wild FROM low l)
    SELECT symbol, component, ROUND(mom_30d, 6) AS mom_30d, ROUND(vol_21d, 6) AS vol_21d, CASE WHEN low AND wild THEN 'bear' WHEN low THEN 'sideways' WHEN wild THEN 'bull_volatile' ELSE 'bull_quiet' END AS regime FROM o""")  # fmt: skip
