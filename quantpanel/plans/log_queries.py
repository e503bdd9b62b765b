"""Decision, execution, news and event logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F


from quantpanel.functions.panel import by_symbol
from quantpanel.operators import logs, ranking, trades

from .common import Catalog, duck, view

CATALOG = Catalog()
add = CATALOG.add
C = F.col


def _trips(s, d, drop=True):
    return trades.round_trips(view(s, d, "executions"), trades.winners(view(s, d, "decisions")), drop)


WON = duck("decisions", "executions") + """, win AS (SELECT plan_id, symbol, agent, regime FROM decisions WHERE is_winner QUALIFY ROW_NUMBER() OVER (PARTITION BY plan_id, symbol ORDER BY timestamp DESC, ordinal DESC) = 1)"""


def _trips_sql(keep: str) -> str:
    return WON + f""", x AS (SELECT e.*, agent, regime, CASE WHEN avg_fill_price > 0 THEN avg_fill_price WHEN limit_price > 0 THEN limit_price ELSE last_price END AS price FROM executions e LEFT JOIN win USING (plan_id, symbol)
    WHERE {keep} AND (side = 'SELL' OR agent IS NOT NULL)),
    r1 AS (SELECT *, SUM(CASE WHEN side = 'BUY' THEN 1 ELSE 0 END) OVER w AS buys, SUM(CASE WHEN side = 'SELL' THEN 1 ELSE 0 END) OVER w AS sells FROM x WINDOW w AS (PARTITION BY symbol ORDER BY timestamp, ordinal ROWS UNBOUNDED PRECEDING)),
    r2 AS (SELECT *, LEAST(0, MIN(buys - sells) OVER (PARTITION BY symbol ORDER BY timestamp, ordinal ROWS UNBOUNDED PRECEDING)) AS m FROM r1),
    r3 AS (SELECT *, COALESCE(LAG(m) OVER (PARTITION BY symbol ORDER BY timestamp, ordinal), 0) AS m0 FROM r2),
    trips AS (SELECT b.symbol, b.buys AS k, b.agent, b.regime, b.price AS entry_price, s.price AS exit_price, b.timestamp AS entry_ts, s.timestamp AS exit_ts, s.price / b.price - 1 AS ret,
              GREATEST(1, DATE_DIFF('day', CAST(b.timestamp AS DATE), CAST(s.timestamp AS DATE))) AS holding_days
              FROM r3 b JOIN r3 s ON b.symbol = s.symbol AND b.side = 'BUY' AND s.side = 'SELL' AND s.m = s.m0 AND b.buys = s.sells + s.m)"""


TRIPS = _trips_sql("avg_fill_price > 0")
add("c10_winner_attribution", lambda s, d: view(s, d, "executions").join(trades.winners(view(s, d, "decisions")), ["plan_id", "symbol"], "left").groupBy("agent", "side").agg(F.count("*").alias("n")),
    WON + " SELECT agent, side, COUNT(*) AS n FROM executions LEFT JOIN win USING (plan_id, symbol) GROUP BY 1, 2")
add("c11_round_trips", lambda s, d: _trips(s, d).select("symbol", "k", "agent", "entry_price", "exit_price", "ret", "holding_days"),
    TRIPS + " SELECT symbol, CAST(k AS BIGINT) AS k, agent, ROUND(entry_price, 6) AS entry_price, ROUND(exit_price, 6) AS exit_price, ROUND(ret, 6) AS ret, holding_days FROM trips")
add("c12_round_trips_by_regime", lambda s, d: _trips(s, d, False).groupBy("regime").agg(F.count("*").alias("n"), F.avg(C("ret") - trades.COST).alias("mean_net")),
    _trips_sql("(avg_fill_price > 0 OR side = 'SELL')") + " SELECT regime, COUNT(*) AS n, ROUND(AVG(ret - 0.0009), 6) AS mean_net FROM trips GROUP BY 1")
add("d13_trip_metrics", lambda s, d: trades.trip_metrics(_trips(s, d)).drop("sharpe"),
    TRIPS + """, c AS (SELECT *, EXP(SUM(LN(1 + ret)) OVER w) AS curve FROM trips WINDOW w AS (PARTITION BY agent ORDER BY exit_ts, symbol, k ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, curve / GREATEST(1, MAX(curve) OVER (PARTITION BY agent ORDER BY exit_ts, symbol, k ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM c)
    SELECT agent, COUNT(*) AS n, ROUND(AVG(CAST(ret > 0 AS INT)), 6) AS win_rate, ROUND(AVG(ret), 6) AS mean_ret, ROUND(SUM(ret), 6) AS total_ret, ROUND(AVG(holding_days), 6) AS avg_hold, ROUND(MIN(dd), 6) AS max_drawdown FROM e GROUP BY agent""")  # fmt: skip
add("d14_trade_sharpe", lambda s, d: trades.trip_metrics(_trips(s, d)).select("agent", "sharpe"),
    TRIPS + """ SELECT agent, ROUND(CASE WHEN COUNT(*) >= 3 THEN CASE WHEN STDDEV_POP(ret) = 0 THEN 0 ELSE (AVG(ret) - 0.04 * AVG(holding_days) / 252) / STDDEV_POP(ret) * SQRT(252 / AVG(holding_days)) END END, 6) AS sharpe FROM trips GROUP BY agent""")
add("d15_half_kelly", lambda s, d: trades.half_kelly(_trips(s, d)),
    TRIPS + """, n AS (SELECT agent, ret - 0.0009 AS net FROM trips), a AS (SELECT agent, COUNT(*) AS n, AVG(net) AS m, AVG(net) FILTER (net > 0) AS w, AVG(-net) FILTER (net <= 0) AS l, AVG(CAST(net > 0 AS INT)) AS p FROM n GROUP BY 1)
    SELECT agent, n, ROUND(CASE WHEN n >= 5 THEN CASE WHEN m <= 0 OR w IS NULL OR l IS NULL OR l = 0 THEN 0 ELSE LEAST(0.25, GREATEST(0, (p * w / l - (1 - p)) / (w / l) / 2)) END END, 6) AS half_kelly FROM a""")  # fmt: skip
add("d12_fill_stats", lambda s, d: trades.fill_stats(view(s, d, "executions")),
    duck("executions") + """ SELECT COUNT(*) AS n, ROUND(AVG(CAST(avg_fill_price > 0 AS INT)), 6) AS fill_rate, ROUND(AVG(slippage_bps) FILTER (avg_fill_price > 0), 6) AS slippage,
    ROUND(AVG(slippage_bps) FILTER (avg_fill_price > 0 AND side = 'BUY'), 6) AS slippage_buy, ROUND(AVG(slippage_bps) FILTER (avg_fill_price > 0 AND side = 'SELL'), 6) AS slippage_sell, MAX(slippage_bps) FILTER (avg_fill_price > 0) AS worst FROM executions""")  # fmt: skip
_NET = ", net AS (SELECT symbol, SUM(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS qty FROM executions WHERE avg_fill_price > 0 GROUP BY 1 HAVING ABS(SUM(CASE WHEN side = 'BUY' THEN qty ELSE -qty END)) > 1e-9)"
add("c16_expected_positions", lambda s, d: trades.net_positions(view(s, d, "executions")), duck("executions") + _NET + " SELECT symbol, ROUND(qty, 6) AS qty FROM net")
add("c15_reconciliation", lambda s, d: trades.reconcile(trades.net_positions(view(s, d, "executions")), trades.net_positions(view(s, d, "executions").where("ordinal % 10 <> 0"))),
    duck("executions") + _NET + """, act AS (SELECT symbol, SUM(CASE WHEN side = 'BUY' THEN qty ELSE -qty END) AS qty FROM executions WHERE avg_fill_price > 0 AND ordinal % 10 <> 0 GROUP BY 1 HAVING ABS(SUM(CASE WHEN side = 'BUY' THEN qty ELSE -qty END)) > 1e-9),
    j AS (SELECT COALESCE(n.symbol, a.symbol) AS symbol, COALESCE(n.qty, 0) AS expected, COALESCE(a.qty, 0) AS actual FROM net n FULL JOIN act a ON n.symbol = a.symbol)
    SELECT symbol, expected, actual, actual - expected AS drift, (SELECT COUNT(*) FROM j) AS n_checked FROM j WHERE ABS(actual - expected) > 0.5""")  # fmt: skip
add("c17_entry_prices", lambda s, d: (lambda e: trades.entry_prices(e.select("symbol").distinct(), e.where("ordinal % 3 = 0").groupBy("symbol").agg(F.max("limit_price").alias("plan_price")).where("symbol < 'S3'"), e.groupBy("symbol").agg(F.min("avg_fill_price").alias("avg_cost")), e))(view(s, d, "executions")),
    duck("executions") + """, p AS (SELECT symbol, MAX(limit_price) AS plan_price FROM executions WHERE ordinal % 3 = 0 AND symbol < 'S3' GROUP BY 1), b AS (SELECT symbol, MIN(avg_fill_price) AS avg_cost FROM executions GROUP BY 1),
    l AS (SELECT symbol, avg_fill_price AS last_price FROM executions WHERE side = 'BUY' AND avg_fill_price > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY timestamp DESC, ordinal DESC) = 1)
    SELECT symbol, ROUND(COALESCE(plan_price, CASE WHEN avg_cost > 0 THEN avg_cost END, last_price), 6) AS entry_price FROM (SELECT DISTINCT symbol FROM executions) LEFT JOIN p USING (symbol) LEFT JOIN b USING (symbol) LEFT JOIN l USING (symbol)""")  # fmt: skip
_LAST = "last_close AS (SELECT symbol, close FROM bars QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"


def _last_close(s, d):
    return view(s, d, "bars").groupBy("symbol").agg(F.max_by("close", "date").alias("close"))


add("c18_stop_losses", lambda s, d: (lambda e: trades.stop_losses(trades.net_positions(e), e.where("side = 'BUY' AND avg_fill_price > 0").groupBy("symbol").agg(F.max_by("avg_fill_price", F.struct("timestamp", "ordinal")).alias("entry_price")), _last_close(s, d)))(view(s, d, "executions")),
    duck("executions", "bars") + _NET + f""", {_LAST}, l AS (SELECT symbol, avg_fill_price AS p FROM executions WHERE side = 'BUY' AND avg_fill_price > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY timestamp DESC, ordinal DESC) = 1)
    SELECT symbol, 'SELL' AS action, qty, ROUND(close / p - 1, 6) AS pnl FROM net JOIN l USING (symbol) JOIN last_close USING (symbol) WHERE qty > 0 AND close / p - 1 < -0.07""")  # fmt: skip
_ACCOUNT = ", acc AS (SELECT symbol AS account, date, close AS netliq FROM bars), pk AS (SELECT *, MAX(netliq) OVER (PARTITION BY account ORDER BY date) AS peak FROM acc)"
_LEVEL = ", lv AS (SELECT *, CASE WHEN 1 - netliq / peak > 0.08 THEN 3 WHEN 1 - netliq / peak > 0.06 THEN 2 WHEN 1 - netliq / peak > 0.04 THEN 1 ELSE 0 END AS l FROM pk)"
add("e18_drawdown_breaker", lambda s, d: trades.drawdown_breaker(view(s, d, "bars").select(C("symbol").alias("account"), "date", C("close").alias("netliq"))).select("account", "date", "drawdown", "level"),
    duck("bars") + _ACCOUNT + _LEVEL + " SELECT account, date, ROUND(1 - netliq / peak, 6) AS drawdown, CASE WHEN MAX(CAST(l = 3 AS INT)) OVER (PARTITION BY account ORDER BY date) = 1 THEN 3 ELSE l END AS level FROM lv", ("date",))
add("e13_equity_drawdown", lambda s, d: trades.drawdown_breaker(view(s, d, "bars").select(C("symbol").alias("account"), "date", C("close").alias("netliq"))).groupBy("account").agg(F.min(-C("drawdown")).alias("max_drawdown")),
    duck("bars") + _ACCOUNT + " SELECT account, ROUND(MIN(netliq / peak - 1), 6) AS max_drawdown FROM pk GROUP BY 1")
add("d18_series_metrics", lambda s, d: trades.series_metrics(view(s, d, "bars").withColumn("ret", C("close") / F.lag("close").over(by_symbol()) - 1), "symbol"),
    duck("bars") + """, r AS (SELECT symbol, close / LAG(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars), x AS (SELECT *, ret - 0.04 / 252 AS x FROM r WHERE ret IS NOT NULL)
    SELECT symbol, COUNT(*) AS n, ROUND(AVG(x) / STDDEV_SAMP(x) * SQRT(252), 6) AS sharpe, ROUND(AVG(x) / SQRT(AVG(CASE WHEN x < 0 THEN x * x ELSE 0 END)) * SQRT(252), 6) AS sortino, ROUND(STDDEV_SAMP(ret) * SQRT(252), 6) AS volatility,
    ROUND(EXP(SUM(LN(1 + ret))) - 1, 6) AS total_return, ROUND(POW(EXP(SUM(LN(1 + ret))), 252.0::DOUBLE / COUNT(*)) - 1, 6) AS annual_return FROM x GROUP BY 1 HAVING COUNT(*) >= 5""")  # fmt: skip
_DAY = "CAST(timestamp AS DATE)"
add("d24_consensus", lambda s, d: ranking.consensus(view(s, d, "decisions").withColumn("day", F.to_date("timestamp")), control="A6"),
    duck("decisions") + f""", v AS (SELECT {_DAY} AS day, symbol, agent, CASE action WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END AS dir FROM decisions WHERE agent <> 'A6'),
    g AS (SELECT day, symbol, COUNT(*) AS eligible, COUNT_IF(dir <> 0) AS speaking, COALESCE(SUM(dir) / NULLIF(COUNT_IF(dir <> 0), 0), 0) AS score, COALESCE(ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT agent) FILTER (dir > 0)), ','), '') AS buyers FROM v GROUP BY 1, 2),
    c AS (SELECT *, ABS(score) * SQRT(speaking / eligible) AS conviction FROM g), a AS (SELECT *, CASE WHEN conviction < 0.15 THEN 'NONE' WHEN score > 0 THEN 'BUY' ELSE 'SELL' END AS action FROM c)
    SELECT day, symbol, eligible, speaking, ROUND(score, 6) AS score, buyers, ROUND(conviction, 6) AS conviction, action, ROUND(CASE WHEN action = 'NONE' THEN 0 ELSE 0.1 * conviction END, 6)::DOUBLE AS weight FROM a""", ("day",))  # fmt: skip
add("b06_latest_run", lambda s, d: logs.latest_run(view(s, d, "decisions")).select("symbol", "agent", "action", "confidence"),
    duck("decisions") + " SELECT symbol, agent, action, confidence FROM decisions WHERE is_winner AND plan_id = (SELECT plan_id FROM decisions ORDER BY timestamp DESC, ordinal DESC LIMIT 1)")
add("f13_last_of_each_symbol", lambda s, d: logs.last_of_each(view(s, d, "decisions")), duck("decisions") + " SELECT symbol, agent, action, confidence, regime FROM decisions QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY timestamp DESC, ordinal DESC) = 1")
add("b07_freshness", lambda s, d: logs.freshness(view(s, d, "decisions"), "timestamp", "2024-02-01 00:00:00"),
    duck("decisions") + " SELECT ROUND((EPOCH(TIMESTAMP '2024-02-01 00:00:00') - FLOOR(EPOCH(MAX(timestamp)))) / 3600, 6) AS age_hours, (EPOCH(TIMESTAMP '2024-02-01 00:00:00') - FLOOR(EPOCH(MAX(timestamp)))) / 3600 <= 72 AS fresh FROM decisions")
add("a12_run_summary", lambda s, d: logs.run_summary(view(s, d, "decisions")),
    duck("decisions") + """, a AS (SELECT plan_id, agent, COUNT(*) AS n, MIN(ordinal) AS seen FROM decisions GROUP BY 1, 2), t AS (SELECT plan_id, agent AS top_agent FROM a QUALIFY ROW_NUMBER() OVER (PARTITION BY plan_id ORDER BY n DESC, seen) = 1),
    g AS (SELECT plan_id, COUNT(*) AS n_signals, COUNT_IF(action = 'BUY') AS n_buy, COUNT_IF(action = 'SELL') AS n_sell, COUNT_IF(action = 'HOLD') AS n_hold FROM decisions GROUP BY 1)
    SELECT plan_id, n_signals, n_buy, n_sell, n_hold, top_agent, SHA256(CONCAT_WS('|', plan_id, n_signals, n_buy, n_sell, n_hold, top_agent)) AS hash FROM g JOIN t USING (plan_id)""")  # fmt: skip
add("a13_signature_mismatches", lambda s, d: logs.mismatches(logs.run_summary(view(s, d, "decisions")).withColumn("n_buy", F.when(C("plan_id").endswith("7"), C("n_buy") + 1).otherwise(C("n_buy")))).select("plan_id"),
    duck("decisions") + " SELECT DISTINCT plan_id FROM decisions WHERE plan_id LIKE '%7'")
add("a06_quarantine", lambda s, d: logs.quarantine(view(s, d, "decisions").withColumn("confidence", F.when(C("ordinal") % 9 == 0, "n/a").otherwise(C("confidence").cast("string"))))[1].groupBy("agent").agg(F.count("*").alias("n")),
    duck("decisions") + " SELECT agent, COUNT(*) AS n FROM decisions WHERE ordinal % 9 = 0 GROUP BY 1")
add("a05_legacy_migration", lambda s, d: logs.migrate_decisions(view(s, d, "decisions").drop("is_winner").withColumnsRenamed({"timestamp": "ts", "agent": "winner_agent"})).groupBy("agent", "is_winner").agg(F.count("*").alias("n"), F.max(F.col("timestamp").cast("string")).alias("last")).drop("last"),
    duck("decisions") + " SELECT agent, TRUE AS is_winner, COUNT(*) AS n FROM decisions GROUP BY 1")
add("d31_strategy_share", lambda s, d: (lambda w: w.groupBy("agent").agg(F.count("*").alias("n")).withColumn("share", C("n") / F.sum("n").over(W.partitionBy())))(view(s, d, "decisions").where("is_winner AND action <> 'HOLD'")),
    duck("decisions") + " SELECT agent, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM decisions WHERE is_winner AND action <> 'HOLD' GROUP BY 1")
_HASH = "SUBSTR(MD5(ARRAY_TO_STRING(LIST_SLICE(LIST_FILTER(STRING_SPLIT_REGEX(TRIM(REGEXP_REPLACE(LOWER(headline), '[^a-z0-9\\s]', '', 'g')), '\\s+'), lambda t: LENGTH(t) > 3), 1, 8), ' ')), 1, 12)"
add("h01_headline_hash", lambda s, d: view(s, d, "news").select("ordinal", logs.headline_hash(C("headline")).alias("fingerprint")), duck("news") + f" SELECT ordinal, {_HASH} AS fingerprint FROM news")
_CAT = "CASE " + " ".join(f"WHEN {' OR '.join(f'CONTAINS(h, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}'" for n, ws in logs.KEYWORDS.items()) + " WHEN CONTAINS(LOWER(native_category), 'earnings') OR CONTAINS(LOWER(native_category), 'ipo') THEN 'earnings' WHEN CONTAINS(LOWER(native_category), 'merger') THEN 'ma' ELSE 'general' END"
add("h02_headline_category", lambda s, d: view(s, d, "news").groupBy(logs.headline_category(C("headline"), C("native_category")).alias("category")).agg(F.count("*").alias("n")),
    duck("news") + f" SELECT {_CAT} AS category, COUNT(*) AS n FROM (SELECT *, ' ' || LOWER(headline) || ' ' AS h FROM news) GROUP BY 1")
add("g05_headline_dedup", lambda s, d: logs.dedup_headlines(view(s, d, "news")).select("ordinal", "ticker"), duck("news") + f" SELECT ordinal, ticker FROM (SELECT *, {_HASH} AS fp FROM news) QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, fp ORDER BY ordinal) = 1")


def _shared_news(s, d):
    """Headlines that several tickers carry, some of which name one."""
    k = C("ordinal") % 40
    return view(s, d, "news").withColumn("headline", F.concat(F.lit("Quarterly report and outlook, part "), k.cast("string").substr(1, 1), F.when(C("ordinal") % 3 == 0, F.concat(F.lit(" "), F.lower("ticker"))).when(C("ordinal") % 7 == 0, " s1").otherwise("")))


# the keeper goes from item to item
add("g06_cross_ticker_dedup", lambda s, d: logs.dedup_across_tickers(_shared_news(s, d)).select("fingerprint", "ticker", "ordinal"),
    "WITH RECURSIVE " + duck("news")[5:] + f""", sh AS (SELECT ordinal, ticker, age_minutes, 'Quarterly report and outlook, part ' || SUBSTR(CAST(ordinal % 40 AS VARCHAR), 1, 1) || CASE WHEN ordinal % 3 = 0 THEN ' ' || LOWER(ticker) WHEN ordinal % 7 = 0 THEN ' s1' ELSE '' END AS headline FROM news),
    it AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fp ORDER BY age_minutes, ordinal) AS k FROM (SELECT *, {_HASH} AS fp FROM sh)),
    st AS (SELECT fp, k, ticker, ordinal FROM it WHERE k = 1 UNION ALL SELECT it.fp, it.k, CASE WHEN NOT CONTAINS(UPPER(headline), UPPER(st.ticker)) AND CONTAINS(UPPER(headline), UPPER(it.ticker)) THEN it.ticker ELSE st.ticker END,
      CASE WHEN NOT CONTAINS(UPPER(headline), UPPER(st.ticker)) AND CONTAINS(UPPER(headline), UPPER(it.ticker)) THEN it.ordinal ELSE st.ordinal END FROM st JOIN it ON it.fp = st.fp AND it.k = st.k + 1)
    SELECT fp AS fingerprint, ticker, ordinal FROM st QUALIFY ROW_NUMBER() OVER (PARTITION BY fp ORDER BY k DESC) = 1""")  # fmt: skip
add("f07_top_news", lambda s, d: logs.top_news(view(s, d, "news").withColumn("category", logs.headline_category(C("headline"), C("native_category"))), ["S1", "S2", "S3", "S4", "S5"]).select("ordinal", "ticker", "score"),
    duck("news") + f""", c AS (SELECT *, {_CAT} AS category FROM (SELECT *, ' ' || LOWER(headline) || ' ' AS h FROM news)),
    s AS (SELECT *, CAST(CASE WHEN ticker IN ('S1', 'S2', 'S3', 'S4', 'S5') THEN 3 ELSE 1 END + CASE WHEN category IN ('ma', 'earnings', 'guidance') THEN 2 WHEN category = 'analyst' THEN 0.5 ELSE 0 END + CASE WHEN age_minutes < 720 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM c),
    r AS (SELECT * FROM s WHERE score >= 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY score DESC, age_minutes, ordinal) <= 2) SELECT ordinal, ticker, score FROM r ORDER BY score DESC, age_minutes, ordinal LIMIT 5""")  # fmt: skip
add("d28_insider_clusters", lambda s, d: logs.insider_clusters(view(s, d, "insider"), "1998-06-30", 365, 20_000.0),
    duck("insider") + """, g AS (SELECT ticker, COUNT(DISTINCT reporter_name) AS reporters, SUM(total_value) AS total, MAX(transaction_date) AS latest FROM insider WHERE (is_officer OR is_director) AND total_value >= 20000 AND transaction_code = 'P'
    AND transaction_date BETWEEN DATE '1998-06-30' - 365 AND DATE '1998-06-30' GROUP BY 1)
    SELECT ticker, reporters, ROUND(total, 6) AS total, latest, CASE WHEN reporters >= 2 THEN 'BUY' ELSE 'HOLD' END AS action, CASE WHEN reporters >= 2 THEN ROUND_EVEN(LEAST(0.85, 0.60 + 0.08 * (reporters - 2)), 3) ELSE 0 END::DOUBLE AS confidence FROM g""", ("latest",))  # fmt: skip
add("f10_recent_events", lambda s, d: view(s, d, "bus_events").where("type = 'error'").orderBy(F.desc("ts"), F.desc(C("id").cast("long"))).limit(20).select("id", "severity", "title"),
    duck("bus_events") + " SELECT id, severity, title FROM bus_events WHERE type = 'error' ORDER BY ts DESC, CAST(id AS BIGINT) DESC LIMIT 20")
_COST = "CASE WHEN {q} = 0 OR {p} <= 0 THEN 0 ELSE GREATEST(1, 0.005 * ABS({q})) + ABS({q}) * {p} * 0.0005 END"
add("h05_transaction_cost", lambda s, d: view(s, d, "executions").select("ordinal", trades.transaction_cost(C("qty"), C("avg_fill_price")).alias("cost"), trades.slippage_bps(C("side"), C("avg_fill_price"), F.lit(103.0)).alias("slippage")),
    duck("executions") + f" SELECT ordinal, ROUND({_COST.format(q='qty', p='avg_fill_price')}, 8)::DOUBLE AS cost, ROUND(CASE WHEN avg_fill_price <= 0 THEN 0 ELSE (avg_fill_price - 103.0::DOUBLE) / 103.0::DOUBLE * 10000 * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END END, 8) AS slippage FROM executions", digits=8)
add("j01_order_plans", lambda s, d: trades.order_plans(view(s, d, "decisions").groupBy("symbol").agg(F.max_by(F.struct("action", "target_weight"), F.struct("timestamp", "ordinal")).alias("x")).select("symbol", "x.*"), s.createDataFrame([(1_000_000.0,)], "netliq double"), trades.net_positions(view(s, d, "executions")), _last_close(s, d).withColumnRenamed("close", "price")),
    duck("decisions", "executions", "bars") + _NET + f""", {_LAST}, s AS (SELECT symbol, action, target_weight FROM decisions QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY timestamp DESC, ordinal DESC) = 1),
    t AS (SELECT symbol, action, COALESCE(qty, 0) AS qty, close AS price, CASE WHEN action = 'SELL' THEN 0 ELSE TRUNC(1000000 * target_weight / close) END AS target_qty FROM s JOIN last_close USING (symbol) LEFT JOIN net USING (symbol)
          WHERE (action = 'SELL' AND qty > 0) OR (action = 'BUY' AND target_weight > 0))
    SELECT symbol, action, qty, target_qty, target_qty - qty AS delta_qty, ROUND(ABS((target_qty - qty) * price), 6) AS est_notional, ROUND({_COST.format(q='(target_qty - qty)', p='price')}, 6)::DOUBLE AS est_cost FROM t WHERE target_qty <> qty""")  # fmt: skip
add("d29_sharpe_weights", lambda s, d: trades.sharpe_weights(trades.trip_metrics(_trips(s, d).withColumn("agent", F.concat_ws("/", "symbol", "agent"))).where("sharpe IS NOT NULL").select(F.split("agent", "/")[0].alias("symbol"), F.split("agent", "/")[1].alias("agent"), "sharpe")),
    TRIPS + """, h AS (SELECT symbol, agent, CASE WHEN STDDEV_POP(ret) = 0 THEN 0 ELSE (AVG(ret) - 0.04 * AVG(holding_days) / 252) / STDDEV_POP(ret) * SQRT(252 / AVG(holding_days)) END AS sharpe FROM trips GROUP BY 1, 2 HAVING COUNT(*) >= 3)
    SELECT symbol, agent, ROUND(sharpe, 6) AS sharpe, ROUND(CASE WHEN sharpe > 0 THEN GREATEST(0.02, LEAST(0.25, 0.1 * sharpe / AVG(sharpe) FILTER (sharpe > 0) OVER (PARTITION BY symbol))) ELSE 0.02 END, 6)::DOUBLE AS weight FROM h""")  # fmt: skip
add("d40_average_daily_volume", lambda s, d: view(s, d, "bars").withColumn("r", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).where("r <= 10").groupBy("symbol").agg(F.when(F.count("*") >= 10, F.avg("volume")).alias("adv")),
    duck("bars") + " SELECT symbol, ROUND(CASE WHEN COUNT(*) >= 10 THEN AVG(volume) END, 6) AS adv FROM (SELECT * FROM bars QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) <= 10) GROUP BY 1")
