"""Bars, quality and feature windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantpanel.operators import features as f
from quantpanel.operators import quality

from .common import Catalog, back, duck, guarded, view

BARS = lambda s, d: view(s, d, "bars")
P = "OVER (PARTITION BY symbol ORDER BY date)"
ATR_CTE = f"""a1 AS (SELECT *, {back('close', 1)} AS pc FROM bars),
a2 AS (SELECT *, GREATEST(high - low, ABS(high - pc), ABS(low - pc)) AS tr FROM a1),
a3 AS (SELECT *, {guarded('AVG', 'tr', 14)} AS atr FROM a2)"""

CATALOG = Catalog()


def add(name: str, query, sql: str, digits: int = 6) -> None:
    CATALOG.add(name, query, sql, () if name[0] == "b" else ("date",), digits)


def _cut(step, *columns):
    return lambda s, d: step(BARS(s, d)).select("symbol", "date", *columns)


add("a01_normalize_bars", lambda s, d: quality.normalize_bars(BARS(s, d)), duck("bars") + " SELECT * FROM bars")
add(
    "b01_quality_verdict",
    lambda s, d: quality.assess(BARS(s, d)),
    duck("bars") + f""", j AS (SELECT symbol, close, COALESCE(CAST(ABS(LN(LEAD(close) {P} / close)) > 0.5 AS INT), 0) AS jump FROM bars),
    v AS (SELECT symbol, COUNT(*) AS n, CAST(SUM(jump) AS BIGINT) AS n_jumps, MAX(close) / MIN(close) AS price_range FROM j GROUP BY symbol)
    SELECT symbol, n, n_jumps, ROUND(price_range, 6) AS price_range, reason, reason IS NULL AS ok
    FROM (SELECT *, CASE WHEN n < 10 THEN 'short' WHEN n_jumps > 5 THEN 'jumps' WHEN n_jumps > 0 AND price_range > 1000 THEN 'range' END AS reason FROM v)""",
)
add(
    "b02_kept_universe",
    lambda s, d: quality.filter_universe(BARS(s, d))[0].groupBy("symbol").agg(F.count("*").alias("n")),
    duck("bars") + f""", j AS (SELECT symbol, close, COALESCE(CAST(ABS(LN(LEAD(close) {P} / close)) > 0.5 AS INT), 0) AS jump FROM bars)
    SELECT symbol, COUNT(*) AS n FROM j GROUP BY symbol HAVING COUNT(*) >= 10 AND SUM(jump) <= 5 AND NOT (SUM(jump) > 0 AND MAX(close) / MIN(close) > 1000)""",
)
add(
    "b03_reject_report",
    lambda s, d: quality.reject_report(quality.assess(BARS(s, d)), 20).select("symbol", "n", "n_jumps", "n_more"),
    duck("bars") + f""", j AS (SELECT symbol, close, COALESCE(CAST(ABS(LN(LEAD(close) {P} / close)) > 0.5 AS INT), 0) AS jump FROM bars),
    v AS (SELECT symbol, COUNT(*) AS n, CAST(SUM(jump) AS BIGINT) AS n_jumps FROM j GROUP BY symbol)
    SELECT symbol, n, n_jumps, GREATEST((SELECT COUNT(*) FROM v) - 20, 0) AS n_more FROM v ORDER BY n_jumps DESC, symbol LIMIT 20""",
)
add(
    "e01_forward_returns", _cut(f.forward_returns, "fwd_1", "fwd_5", "fwd_20"),
    duck("bars") + " SELECT symbol, date, " + ", ".join(f"ROUND(LN(LEAD(close, {h}) {P} / close), 6) AS fwd_{h}" for h in (1, 5, 20)) + " FROM bars",
)
add("e02_moving_averages", _cut(f.moving_averages, "sma20", "sma50", "sma200"), duck("bars") + " SELECT symbol, date, " + ", ".join(f"ROUND({guarded('AVG', 'close', n)}, 10) AS sma{n}" for n in (20, 50, 200)) + " FROM bars", 10)
add(
    "e03_trend_regime", _cut(lambda b: f.trend_regime(f.moving_averages(b)), "regime"),
    duck("bars") + f""", m AS (SELECT symbol, date, close AS c, {guarded('AVG', 'close', 50)} AS f, {guarded('AVG', 'close', 200)} AS s FROM bars)
    SELECT symbol, date, CASE WHEN c > f AND f > s THEN 'bull' WHEN c < f AND f < s THEN 'bear' ELSE 'choppy' END AS regime FROM m""",
)
add(
    "e04_average_true_range", _cut(f.average_true_range, "atr", "atr_pct", "vol_regime"),
    duck("bars") + f""", {ATR_CTE} SELECT symbol, date, ROUND(atr, 7) AS atr, ROUND(atr / close, 7) AS atr_pct,
    CASE WHEN atr / close < 0.008 THEN 'low' WHEN atr / close > 0.018 THEN 'high' WHEN atr IS NOT NULL THEN 'normal' END AS vol_regime FROM a3""", 7,
)
add(
    "e05_rsi", _cut(f.rsi, "rsi"),
    duck("bars") + f""", r1 AS (SELECT *, close - {back('close', 1)} AS d FROM bars),
    r2 AS (SELECT *, CASE WHEN d IS NOT NULL THEN GREATEST(d, 0) END AS gain, CASE WHEN d IS NOT NULL THEN GREATEST(-d, 0) END AS loss FROM r1),
    r3 AS (SELECT *, {guarded('AVG', 'gain', 14)} AS g, {guarded('AVG', 'loss', 14)} AS l FROM r2)
    SELECT symbol, date, ROUND(CASE WHEN l = 0 THEN 0 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM r3""",
)
add(
    "e06_bollinger", _cut(f.bollinger, "bb_lower", "bb_upper"),
    duck("bars") + f""", m AS (SELECT symbol, date, {guarded('AVG', 'close', 20)} AS m, {guarded('STDDEV_SAMP', 'close', 20)} AS s FROM bars)
    SELECT symbol, date, ROUND(m - 2 * s, 6) AS bb_lower, ROUND(m + 2 * s, 6) AS bb_upper FROM m""",
)
add(
    "e07_adx", _cut(lambda b: f.adx(f.average_true_range(b)), "adx"),
    duck("bars") + f""", {ATR_CTE},
    x1 AS (SELECT *, GREATEST(high - {back('high', 1)}, CASE WHEN pc IS NOT NULL THEN 0 END) AS p0, pc IS NOT NULL AS known, high - {back('high', 1)} AS up, {back('low', 1)} - low AS dn FROM a3),
    x2 AS (SELECT *, CASE WHEN known THEN GREATEST(up, 0) END AS pdm, CASE WHEN known THEN GREATEST(dn, 0) END AS mdm FROM x1),
    x3 AS (SELECT *, 100 * ({guarded('AVG', 'pdm', 14)}) / NULLIF(atr, 0) AS pdi, 100 * ({guarded('AVG', 'mdm', 14)}) / NULLIF(atr, 0) AS mdi FROM x2),
    x4 AS (SELECT *, 100 * ABS(pdi - mdi) / NULLIF(pdi + mdi, 0) AS dx FROM x3)
    SELECT symbol, date, ROUND({guarded('AVG', 'dx', 14)}, 6) AS adx FROM x4""",
)
add(
    "e08_momentum_breakouts", _cut(f.momentum, "mom20", "mom21", "mom50", "mom63", "mom126", "prior_high20", "prior_low20"),
    duck("bars") + " SELECT symbol, date, " + ", ".join(f"ROUND(close / {back('close', k)} - 1, 6) AS mom{k}" for k in (20, 21, 50, 63, 126))
    + f", ROUND({guarded('MAX', 'high', 20, back=1)}, 6) AS prior_high20, ROUND({guarded('MIN', 'low', 20, back=1)}, 6) AS prior_low20 FROM bars",
)
add("e09_volume_ratio", _cut(f.volume_ratio, "volume_ratio"), duck("bars") + f" SELECT symbol, date, ROUND(volume / NULLIF({guarded('AVG', 'volume', 20, back=1)}, 0), 6) AS volume_ratio FROM bars")
RET = f"r AS (SELECT *, close / {back('close', 1)} - 1 AS ret1 FROM bars)"
add(
    "e10_volatility", _cut(f.volatility, "vol20", "near_high252", "drawdown60"),
    duck("bars") + f""", {RET} SELECT symbol, date, ROUND({guarded('STDDEV_SAMP', 'ret1', 20)}, 6) AS vol20, ROUND(close / ({guarded('MAX', 'close', 252, 1)}), 6) AS near_high252,
    ROUND(1 - close / ({guarded('MAX', 'close', 60, 1)}), 6) AS drawdown60 FROM r""",
)
add("e11_realized_volatility", _cut(f.volatility, "realized_vol"), duck("bars") + f", {RET} SELECT symbol, date, ROUND(({guarded('STDDEV_SAMP', 'ret1', 20, 5)}) * SQRT(252), 6) AS realized_vol FROM r")
_SCORE = ", ".join(f"{back('close', 21)} / {back('close', 21 + p)} - 1" for p in (63, 126, 252))
add("e12_momentum_score", _cut(f.momentum_score, "mom_score"), duck("bars") + f" SELECT symbol, date, ROUND(LIST_AVG(LIST_FILTER([{_SCORE}], lambda x: x IS NOT NULL)), 6) AS mom_score FROM bars")
add("e14_market_drawdown", _cut(f.market_drawdown, "drawdown"), duck("bars") + f" SELECT symbol, date, ROUND(1 - close / ({guarded('MAX', 'close', 252, 60)}), 6) AS drawdown FROM bars")
_W252 = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
add(
    "e15_index_extremes", _cut(f.index_extremes, "vix_z", "vix_mom5", "vix_ratio"),
    duck("bars") + f""", x AS (SELECT *, COUNT(close) {_W252} >= 30 AS ok, (close - AVG(close) {_W252}) / NULLIF(STDDEV_SAMP(close) {_W252}, 0) AS z FROM bars)
    SELECT symbol, date, ROUND(CASE WHEN ok THEN COALESCE(z, 0) ELSE 0 END, 6) AS vix_z, ROUND(CASE WHEN ok THEN close / {back('close', 5)} - 1 ELSE 0 END, 6) AS vix_mom5,
    ROUND(CASE WHEN ok THEN close / ({guarded('AVG', 'close', 20)}) ELSE 1 END, 6) AS vix_ratio FROM x""",
)
add(
    "e16_regime_matrix", lambda s, d: f.regime_matrix(f.volatility(f.average_true_range(BARS(s, d)))),
    duck("bars") + f""", {ATR_CTE}, r AS (SELECT *, close / pc - 1 AS ret1 FROM a3),
    m AS (SELECT symbol, date, ROUND(({guarded('STDDEV_SAMP', 'ret1', 5)}) * SQRT(252), 6) AS vol_5d, ROUND(({guarded('STDDEV_SAMP', 'ret1', 21)}) * SQRT(252), 6) AS vol_21d,
    ROUND(close / {back('close', 10)} - 1, 6) AS mom_10d, ROUND(close / {back('close', 30)} - 1, 6) AS mom_30d, ROUND({guarded('SUM', 'ret1', 21)}, 6) AS ret_21d, ROUND(atr / close, 6) AS atr_pct FROM r)
    SELECT * FROM m WHERE vol_5d IS NOT NULL AND vol_21d IS NOT NULL AND mom_10d IS NOT NULL AND mom_30d IS NOT NULL AND ret_21d IS NOT NULL AND atr_pct IS NOT NULL""",
)
add(
    "e17_volatility_sizing", _cut(f.volatility_sizing, "sized_weight"),
    duck("bars") + f""", r AS (SELECT *, LN(close / {back('close', 1)}) AS lr, ROW_NUMBER() {P} AS n FROM bars),
    q AS (SELECT *, ({guarded('STDDEV_SAMP', 'lr', 20)}) / NULLIF({guarded('STDDEV_SAMP', 'lr', 252)}, 0) AS ratio FROM r)
    SELECT symbol, date, CASE WHEN n >= 272 AND ratio > 2 THEN 0.05 ELSE 0.1 END::DOUBLE AS sized_weight FROM q""",
)
