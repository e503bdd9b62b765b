"""Equity, risk and pair reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.panel import weekdays_after
from quantpanel.operators import risk, trades

from .common import Catalog, duck, view

CATALOG = Catalog()
add = CATALOG.add
C = F.col
_P = "OVER (PARTITION BY symbol ORDER BY date)"
_TAIL = "QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) <= {n}"


def bars(s, d):
    return view(s, d, "bars")


def books(s, d):
    """Books of three neighbouring symbols of a sector."""
    rank = F.row_number().over(W.partitionBy("sector").orderBy("ticker")) - 1
    return view(s, d, "sectors").select(F.concat_ws("/", "sector", F.floor(rank / 3).cast("string")).alias("book"), C("ticker").alias("symbol"))


def neighbours(s, d):
    """(a, b): every symbol and the next one of its sector."""
    following = F.lead("ticker").over(W.partitionBy("sector").orderBy("ticker"))
    return view(s, d, "sectors").select(C("ticker").alias("a"), following.alias("b")).where("b IS NOT NULL")


BOOKS = "books AS (SELECT sector || '/' || CAST((ROW_NUMBER() OVER (PARTITION BY sector ORDER BY ticker) - 1) // 3 AS VARCHAR) AS book, ticker AS symbol FROM sectors)"
PAIRS = "pairs AS (SELECT a, b FROM (SELECT ticker AS a, LEAD(ticker) OVER (PARTITION BY sector ORDER BY ticker) AS b FROM sectors) WHERE b IS NOT NULL)"
add("d26_historical_var", lambda s, d: risk.historical_var(bars(s, d), books(s, d).withColumn("qty", F.lit(100.0)), 1500),
    duck("bars", "sectors") + f""", {BOOKS}, t AS (SELECT b.*, book FROM (SELECT * FROM bars {_TAIL.format(n=1500)}) b JOIN books USING (symbol)), n AS (SELECT book, symbol, ARG_MAX(close, date) AS last FROM t GROUP BY 1, 2 HAVING COUNT(*) >= 21),
    k AS (SELECT book, COUNT(*) AS k, SUM(last * 100.0) AS value FROM n GROUP BY 1), r AS (SELECT t.*, last FROM t JOIN n USING (book, symbol)), sh AS (SELECT book, date FROM r JOIN k USING (book) GROUP BY book, date, k HAVING COUNT(*) = k),
    x AS (SELECT r.*, close / LAG(close) OVER (PARTITION BY book, symbol ORDER BY date) - 1 AS ret FROM r JOIN sh USING (book, date)), p AS (SELECT book, date, SUM(ret * 100.0 * last) AS pnl FROM x WHERE ret IS NOT NULL GROUP BY 1, 2),
    q AS (SELECT book, QUANTILE_CONT(pnl, 0.05) AS a, QUANTILE_CONT(pnl, 0.01) AS b, COUNT(*) AS c FROM p GROUP BY 1), c AS (SELECT book, AVG(pnl) FILTER (pnl <= b) AS m FROM p JOIN q USING (book) GROUP BY 1)
    SELECT book, c AS n_days, ROUND(-a, 6) AS var95, ROUND(-b, 6) AS var99, ROUND(-m, 6) AS cvar99, ROUND(value, 6)::DOUBLE AS value, ROUND(-b / value, 6) AS var99_pct FROM q JOIN c USING (book) JOIN k USING (book)""")  # fmt: skip
add("d27_correlations", lambda s, d: risk.correlations(bars(s, d), 400, 5),
    duck("bars") + f""", t AS (SELECT * FROM bars {_TAIL.format(n=401)}), r AS (SELECT symbol, date, close / LAG(close) {_P} - 1 AS ret FROM t)
    SELECT x.symbol AS a, y.symbol AS b, COUNT(*) AS n, ROUND(CORR(x.ret, y.ret), 6) AS corr FROM r x JOIN r y ON x.date = y.date AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 5""")  # fmt: skip


_SPREAD = duck("bars", "sectors") + f""", {PAIRS}, px AS (SELECT symbol, date, LN(close) AS p FROM bars),
j AS (SELECT x.symbol AS a, y.symbol AS b, x.date, x.p AS pa, y.p AS pb FROM pairs JOIN px x ON x.symbol = a JOIN px y ON y.symbol = b AND x.date = y.date), be AS (SELECT a, b, REGR_SLOPE(pa, pb) AS beta, COUNT(*) AS n FROM j GROUP BY 1, 2),
sp AS (SELECT j.*, beta, n, pa - beta * pb AS s FROM j JOIN be USING (a, b)), sd AS (SELECT *, CAST(s - AVG(s) OVER (PARTITION BY a, b) >= 0 AS INT) AS side, LAG(s) OVER (PARTITION BY a, b ORDER BY date) AS s0 FROM sp),
cr AS (SELECT *, CAST(side <> LAG(side) OVER (PARTITION BY a, b ORDER BY date) AS INT) AS crossed FROM sd)"""
add("e23_spread_statistics", lambda s, d: risk.spread_stats(bars(s, d), neighbours(s, d)),
    _SPREAD + """ SELECT a, b, ANY_VALUE(n) AS n, ROUND(ANY_VALUE(beta), 6) AS beta, CAST(SUM(crossed) AS BIGINT) AS crossings, ROUND(CASE WHEN COUNT(s0) >= 20 AND REGR_SLOPE(s - s0, s0) < 0 THEN LN(2) / -REGR_SLOPE(s - s0, s0) END, 6) AS half_life FROM cr GROUP BY a, b""")
add("c13_pair_alignment", lambda s, d: bars(s, d).withColumnsRenamed({"symbol": "a", "close": "ca"}).join(neighbours(s, d), "a").join(bars(s, d).withColumnsRenamed({"symbol": "b", "close": "cb"}).select("b", "date", "cb"), ["b", "date"]).groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(C("ca") / C("cb")).alias("mean_ratio")),
    duck("bars", "sectors") + f""", {PAIRS} SELECT a, b, COUNT(*) AS n, ROUND(AVG(x.close / y.close), 6) AS mean_ratio FROM pairs JOIN bars x ON x.symbol = a JOIN bars y ON y.symbol = b AND x.date = y.date GROUP BY 1, 2""")
add("e22_spread_zscore", lambda s, d: risk.spread_zscore(bars(s, d), neighbours(s, d).withColumn("beta", F.lit(0.5))).select("a", "b", "date", "s", "z"),
    duck("bars", "sectors") + f""", {PAIRS}, j AS (SELECT a, b, x.date, LN(x.close) - 0.5 * LN(y.close) AS s FROM pairs JOIN bars x ON x.symbol = a JOIN bars y ON y.symbol = b AND x.date = y.date),
    w AS (SELECT *, COUNT(s) OVER v AS n, AVG(s) OVER v AS m, STDDEV_SAMP(s) OVER v AS sd FROM j WINDOW v AS (PARTITION BY a, b ORDER BY date ROWS 62 PRECEDING)) SELECT a, b, date, ROUND(s, 6) AS s, ROUND(CASE WHEN n = 63 AND sd >= 1e-6 THEN (s - m) / sd END, 6) AS z FROM w""", ("date",))  # fmt: skip


def _earnings(s, d):
    from quantpanel.functions.panel import by_symbol

    return bars(s, d).withColumn("r", F.row_number().over(by_symbol())).where("r % 13 = 0").select("symbol", C("date").alias("earnings_date"))


add("c19_earnings_blackout", lambda s, d: risk.earnings_blackout(bars(s, d).select("symbol", "date"), _earnings(s, d)),
    duck("bars") + f""", e AS (SELECT symbol, date AS ed FROM (SELECT symbol, date, ROW_NUMBER() {_P} AS r FROM bars) WHERE r % 13 = 0),
    n AS (SELECT b.symbol, b.date, ed FROM bars b JOIN e ON b.symbol = e.symbol AND ed BETWEEN b.date - 2 AND b.date + 7),
    w AS (SELECT *, CAST(LEN(LIST_FILTER(GENERATE_SERIES(LEAST(date, ed)::TIMESTAMP, GREATEST(date, ed)::TIMESTAMP - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: ISODOW(x) < 6)) AS INT) AS k FROM n)
    SELECT DISTINCT symbol, date FROM w WHERE CASE WHEN ed >= date THEN k ELSE -k END BETWEEN 0 AND 3""", ("date",))  # fmt: skip
add("e27_next_open_fills", lambda s, d: risk.next_open_fills(bars(s, d).select("symbol", "date", F.when(C("volume") > 25, "BUY").otherwise("SELL").alias("side"), C("close").alias("limit")), bars(s, d)).groupBy("side").agg(F.count("*").alias("n"), F.avg(C("filled").cast("double")).alias("fill_rate"), F.avg("fill_price").alias("mean_price")),
    duck("bars") + f""", o AS (SELECT CASE WHEN volume > 25 THEN 'BUY' ELSE 'SELL' END AS side, close AS lim, LEAD(open) {_P} AS nx FROM bars), f AS (SELECT *, COALESCE(CASE WHEN side = 'BUY' THEN nx <= lim ELSE nx >= lim END, FALSE) AS filled FROM o)
    SELECT side, COUNT(*) AS n, ROUND(AVG(CAST(filled AS INT)), 6) AS fill_rate, ROUND(AVG(CASE WHEN filled THEN nx END), 6) AS mean_price FROM f GROUP BY 1""")  # fmt: skip
WALK_FORWARD = _WF = duck("bars") + f""", i AS (SELECT symbol, date, close, ROW_NUMBER() {_P} - 1 AS i, COUNT(*) OVER (PARTITION BY symbol) AS n FROM bars),
k AS (SELECT symbol, UNNEST(GENERATE_SERIES(0, n - 504, 63)) AS st FROM (SELECT DISTINCT symbol, n FROM i WHERE n >= 504)),
wf AS (SELECT k.symbol, CAST(st / 63 AS INT) AS "window", MAX(date) FILTER (i = st) AS train_start, MAX(date) FILTER (i = st + 377) AS train_end, MAX(date) FILTER (i = st + 378) AS test_start, MAX(date) FILTER (i = st + 503) AS test_end FROM k JOIN i USING (symbol) GROUP BY 1, 2)"""
add("e19_walk_forward_windows", lambda s, d: risk.walk_forward_windows(bars(s, d)), _WF + " SELECT * FROM wf", ("train_start", "train_end", "test_start", "test_end"))
add("c21_buy_and_hold", lambda s, d: risk.buy_and_hold(risk.walk_forward_windows(bars(s, d)), bars(s, d)),
    _WF + """ SELECT wf.symbol, wf."window", ROUND_EVEN(ARG_MAX(close, date) / ARG_MIN(close, date) - 1, 4) AS asset_return FROM wf JOIN bars b ON wf.symbol = b.symbol AND date BETWEEN test_start AND test_end GROUP BY 1, 2""")
_MONTHS = ", ".join(f"ROUND(MAX(r) FILTER (m = {m}), 6) AS m{m:02d}" for m in range(1, 13))
add("d20_monthly_returns", lambda s, d: risk.monthly_returns(bars(s, d)),
    duck("bars") + f""", l AS (SELECT symbol, YEAR(date) AS y, MONTH(date) AS m, ARG_MAX(close, date) AS v FROM bars GROUP BY 1, 2, 3), c AS (SELECT *, v / LAG(v) OVER (PARTITION BY symbol ORDER BY y, m) - 1 AS r FROM l)
    SELECT symbol, CAST(y AS INT) AS year, {_MONTHS} FROM c GROUP BY 1, 2""")  # fmt: skip
add("h07_dividend_net_edge", lambda s, d: bars(s, d).select("symbol", "date", risk.dividend_net_edge(0.005 + C("volume") / 1000, F.lit(9.0), C("high") / C("low") - 1).alias("edge")),
    duck("bars") + " SELECT symbol, date, ROUND((0.005 + volume / 1000) * 0.85 - 0.04 * 9 / 365 - 0.0009 - 0.5 * 1.645 * (high / low - 1) * SQRT(9.0::DOUBLE), 6) AS edge FROM bars", ("date",))
add("h10_business_days", lambda s, d: bars(s, d).select("symbol", "date", weekdays_after(C("date"), F.date_add("date", C("volume").cast("int") % 20)).alias("n")),
    duck("bars") + " SELECT symbol, date, CAST(LEN(LIST_FILTER(GENERATE_SERIES(date::TIMESTAMP, date::TIMESTAMP + TO_DAYS(CAST(volume AS INT) % 20) - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: ISODOW(x) < 6)) AS INT) AS n FROM bars", ("date",))
