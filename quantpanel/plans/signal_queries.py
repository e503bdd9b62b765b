"""Strategies, labels, edge tables, ranks and arbitration, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantpanel.operators import edge, features, ranking, strategies
from quantpanel.sources.scratch import written

from .common import Catalog, back, duck, guarded, view

CATALOG = Catalog()
add = CATALOG.add


def _panel(s, d):
    return features.features(view(s, d, "bars"))


def _signals(s, d, names=None):
    return strategies.signals(_panel(s, d), names)


def _returns(s, d):
    return edge.long_returns(features.forward_returns(view(s, d, "bars")))


def edge_tables(s, d):
    """(signals with their forward returns, long returns), both from one written pass over the bars."""
    fwd = tuple(f"fwd_{h}" for h in features.HORIZONS)
    rows = written(strategies.decided(_panel(s, d), keep=fwd), "decided")
    return strategies.unfolded(rows).where("error IS NULL").drop("error"), edge.long_returns(rows)


_P = "OVER (PARTITION BY symbol ORDER BY date)"
FEATURES = duck("bars") + f""",
f1 AS (SELECT *, ROW_NUMBER() {_P} AS n_bars, {back('close', 1)} AS pc, {back('high', 1)} AS ph, {back('low', 1)} AS pl,
       {guarded('AVG', 'close', 20)} AS sma20, {guarded('AVG', 'close', 50)} AS sma50, {guarded('AVG', 'close', 200)} AS sma200,
       {guarded('STDDEV_SAMP', 'close', 20)} AS sd20, close / {back('close', 20)} - 1 AS mom20, close / {back('close', 21)} - 1 AS mom21,
       close / {back('close', 50)} - 1 AS mom50, close / {back('close', 63)} - 1 AS mom63, close / {back('close', 126)} - 1 AS mom126,
       {guarded('MAX', 'high', 20, back=1)} AS prior_high20, {guarded('MIN', 'low', 20, back=1)} AS prior_low20,
       volume / NULLIF({guarded('AVG', 'volume', 20, back=1)}, 0) AS volume_ratio, close / ({guarded('MAX', 'close', 252, 1)}) AS near_high252,
       1 - close / ({guarded('MAX', 'close', 60, 1)}) AS drawdown60 FROM bars),
f2 AS (SELECT *, close / pc - 1 AS ret1, GREATEST(high - low, ABS(high - pc), ABS(low - pc)) AS tr, CASE WHEN pc IS NOT NULL THEN GREATEST(close - pc, 0) END AS gain,
       CASE WHEN pc IS NOT NULL THEN GREATEST(pc - close, 0) END AS loss, CASE WHEN pc IS NOT NULL THEN GREATEST(high - ph, 0) END AS pdm, CASE WHEN pc IS NOT NULL THEN GREATEST(pl - low, 0) END AS mdm,
       sma20 - 2 * sd20 AS bb_lower, CASE WHEN close > sma50 AND sma50 > sma200 THEN 'bull' WHEN close < sma50 AND sma50 < sma200 THEN 'bear' ELSE 'choppy' END AS regime FROM f1),
f3 AS (SELECT *, {guarded('AVG', 'tr', 14)} AS atr, {guarded('AVG', 'gain', 14)} AS g, {guarded('AVG', 'loss', 14)} AS l, {guarded('STDDEV_SAMP', 'ret1', 20)} AS vol20,
       ({guarded('STDDEV_SAMP', 'ret1', 20, 5)}) * SQRT(252) AS rvol, {guarded('AVG', 'pdm', 14)} AS pa, {guarded('AVG', 'mdm', 14)} AS ma FROM f2),
f4 AS (SELECT *, atr / close AS atr_pct, CASE WHEN l = 0 THEN 0 ELSE 100 - 100 / (1 + g / l) END AS rsi, 100 * ABS(pa - ma) / NULLIF(pa + ma, 0) AS dx FROM f3),
f AS (SELECT *, {guarded('AVG', 'dx', 14)} AS adx FROM f4)"""

# action, confidence and weight of a replay without positions
RULES = {
    "quality_trend": (260, """CASE WHEN regime = 'bear' THEN 'HOLD' WHEN sc >= 2 THEN 'BUY' ELSE 'HOLD' END""",
        "CASE WHEN regime = 'bear' THEN 0.7 ELSE CASE sc WHEN 0 THEN 0.35 WHEN 1 THEN 0.55 WHEN 2 THEN 0.70 ELSE 0.90 END END", "0.10",
        "COALESCE(CAST(close > sma200 AS INT), 0) + COALESCE(CAST(vol20 <= 0.03 AS INT), 0) + COALESCE(CAST(near_high252 >= 0.85 AS INT), 0)"),
    "multifactor": (210, """CASE WHEN regime <> 'bear' AND close > sma200 AND sma50 > sma200 AND volume_ratio > 0.8 AND (close > prior_high20 OR (mom63 > 0.05 AND mom21 > 0.01)) THEN 'BUY' ELSE 'HOLD' END""",
        """CASE WHEN regime = 'bear' THEN 0.2 WHEN close > sma200 AND sma50 > sma200 AND volume_ratio > 0.8 AND (close > prior_high20 OR (mom63 > 0.05 AND mom21 > 0.01))
           THEN LEAST(0.95, 0.65 + CASE WHEN close > prior_high20 THEN 0.10 ELSE 0 END + CASE WHEN mom63 > 0.08 THEN 0.10 ELSE 0 END + 0.05 + CASE WHEN atr_pct < 0.015 THEN 0.05 ELSE 0 END)
           WHEN close > sma200 AND sma50 > sma200 THEN 0.3 ELSE 0.1 END""", "0.12", "0"),
    "mean_reversion": (50, """CASE WHEN rsi < CASE WHEN regime = 'bear' THEN 30 ELSE 35 END AND close < bb_lower AND volume_ratio > 1.2 THEN 'BUY' ELSE 'HOLD' END""",
        """CASE WHEN rsi < CASE WHEN regime = 'bear' THEN 30 ELSE 35 END AND close < bb_lower AND volume_ratio > 1.2
           THEN LEAST(0.92, 0.65 + CASE WHEN rsi < 25 THEN 0.10 ELSE 0 END + CASE WHEN close < bb_lower * 0.99 THEN 0.10 ELSE 0 END + 0.05) ELSE 0.3 END""", "0.08", "0"),
    "trend_following": (210, """CASE WHEN regime <> 'bear' AND close > sma20 AND sma20 > sma50 AND sma50 > sma200 AND adx > 25 AND mom20 > 0.01 THEN 'BUY' ELSE 'HOLD' END""",
        """CASE WHEN regime = 'bear' THEN 0.2 WHEN close > sma20 AND sma20 > sma50 AND sma50 > sma200 AND adx > 25 AND mom20 > 0.01
           THEN LEAST(0.92, 0.65 + CASE WHEN adx > 30 THEN 0.10 ELSE 0 END + CASE WHEN mom50 > 0.05 THEN 0.10 ELSE 0 END + CASE WHEN mom20 > 0.03 THEN 0.05 ELSE 0 END) ELSE 0.3 END""", "0.10", "0"),
    "long_short_trend": (210, """CASE WHEN adx >= 20 AND rvol > 0 AND mom63 > 0 AND mom126 > 0 AND close > sma200 THEN 'BUY' WHEN adx >= 20 AND rvol > 0 AND mom63 < 0 AND mom126 < 0 AND close < sma200 THEN 'SELL' ELSE 'HOLD' END""",
        """CASE WHEN adx >= 20 AND rvol > 0 AND ((mom63 > 0 AND mom126 > 0 AND close > sma200) OR (mom63 < 0 AND mom126 < 0 AND close < sma200)) THEN LEAST(1.0, GREATEST(0.0, (adx - 20) / 30)) ELSE 0.3 END""",
        "CASE WHEN mom63 > 0 THEN 1 ELSE -1 END * LEAST(0.10 / rvol, 0.15)", "0"),
}


def _rule_sql(name: str, k: int, source: str = "f") -> str:
    least, action, conf, weight, score = RULES[name]
    return f"""SELECT symbol, date, {k} AS agent_ord, '{name}' AS agent, action, CAST(confidence AS DOUBLE) AS confidence, CAST(CASE WHEN action = 'HOLD' THEN 0 ELSE weight END AS DOUBLE) AS target_weight
    FROM (SELECT symbol, date, {action} AS action, {conf} AS confidence, {weight} AS weight FROM (SELECT *, {score} AS sc FROM {source} WHERE n_bars >= {least}))"""


SIGNALS = FEATURES + ",\nsignals AS (" + "\nUNION ALL\n".join(_rule_sql(n, k) for k, n in enumerate(RULES)) + ")"
RETURNS = ", fw AS (" + " UNION ALL ".join(f"SELECT symbol, date, {h} AS horizon, LN(LEAD(close, {h}) {_P} / close) AS fwd FROM bars" for h in (1, 5, 20)) + ")"
BASE = """, base AS (SELECT horizon, AVG(CAST(fwd > 0.003 AS INT)) AS base_buy, AVG(CAST(fwd < -0.003 AS INT)) AS base_sell, AVG(fwd) AS base_mean
FROM fw WHERE fwd IS NOT NULL AND date IN (SELECT date FROM signals) GROUP BY horizon)"""
LABELS = """, lab AS (SELECT s.*, horizon, fwd, CASE WHEN action = 'BUY' THEN CAST(fwd > 0.003 AS INT) ELSE CAST(fwd < -0.003 AS INT) END AS hit
FROM signals s JOIN fw USING (symbol, date) WHERE action <> 'HOLD' AND fwd IS NOT NULL)"""

for _k, _n in enumerate(RULES):
    add(
        f"i{(1, 2, 3, 4, 8)[_k]:02d}_{_n}", lambda s, d, n=_n: _signals(s, d, [n]).select("symbol", "date", "action", "confidence", "target_weight"),
        FEATURES + f" SELECT symbol, date, action, ROUND(confidence, 6) AS confidence, ROUND(target_weight, 6) AS target_weight FROM ({_rule_sql(_n, _k)})", ("date",),
    )
add(
    "b05_success_labels", lambda s, d: _returns(s, d).join(_signals(s, d, ["mean_reversion"]), ["symbol", "date"]).where("horizon = 5").select("symbol", "date", "action", edge.success(F.col("action"), F.col("fwd"), with_hold=True).alias("hit")),
    SIGNALS + RETURNS + """ SELECT symbol, date, action, CASE WHEN fwd IS NULL THEN NULL WHEN action = 'BUY' THEN CAST(fwd > 0.003 AS INT) WHEN action = 'SELL' THEN CAST(fwd < -0.003 AS INT) ELSE CAST(ABS(fwd) <= 0.003 AS INT) END AS hit
    FROM signals JOIN fw USING (symbol, date) WHERE agent = 'mean_reversion' AND horizon = 5""", ("date",),
)
add("c01_signals_with_returns", lambda s, d: edge.labelled(*edge_tables(s, d)).groupBy("agent", "action", "horizon").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean_fwd"), F.sum("hit").alias("hits")),
    SIGNALS + RETURNS + LABELS + " SELECT agent, action, horizon, COUNT(*) AS n, ROUND(AVG(fwd), 6) AS mean_fwd, CAST(SUM(hit) AS BIGINT) AS hits FROM lab GROUP BY ALL")
add("d01_base_rates", lambda s, d: edge.base_rates(*reversed(edge_tables(s, d))), SIGNALS + RETURNS + BASE + " SELECT horizon, ROUND(base_buy, 6) AS base_buy, ROUND(base_sell, 6) AS base_sell, ROUND(base_mean, 6) AS base_mean FROM base")
_Z = 1.959964
add(
    "d02_agent_edge", lambda s, d: edge.agent_edge(*edge_tables(s, d)),
    SIGNALS + RETURNS + BASE + LABELS + f""", a AS (SELECT agent, horizon, COUNT(*) AS n, COUNT(DISTINCT date) AS n_dates, COUNT_IF(action = 'BUY') AS n_buy, COUNT_IF(action = 'SELL') AS n_sell, SUM(hit) AS hits FROM lab GROUP BY 1, 2),
    e AS (SELECT g.agent, base.horizon, COALESCE(n, 0) AS n, COALESCE(n_dates, 0) AS n_dates, COALESCE(n_buy, 0) AS n_buy, COALESCE(n_sell, 0) AS n_sell, COALESCE(hits, 0) AS hits, base_buy, base_sell
          FROM (SELECT DISTINCT agent FROM signals) g CROSS JOIN base LEFT JOIN a ON a.agent = g.agent AND a.horizon = base.horizon),
    w AS (SELECT *, hits / NULLIF(n, 0) AS p, (n_buy * base_buy + n_sell * base_sell) / NULLIF(n, 0) AS x, 1 + {_Z * _Z} / NULLIF(n, 0) AS q FROM e)
    SELECT agent, horizon, n, n_dates, n_buy, n_sell, ROUND(p, 6) AS hit, ROUND(x, 6) AS expected, ROUND(p - x, 6) AS excess,
           ROUND(CASE WHEN n > 0 THEN GREATEST(0, (p + {_Z * _Z / 2} / n) / q - {_Z} * SQRT(p * (1 - p) / n + {_Z * _Z / 4} / (n * n)) / q) ELSE 0 END, 6) AS wilson_low,
           ROUND(CASE WHEN n > 0 THEN LEAST(1, (p + {_Z * _Z / 2} / n) / q + {_Z} * SQRT(p * (1 - p) / n + {_Z * _Z / 4} / (n * n)) / q) ELSE 1 END, 6) AS wilson_high FROM w""",
)
add(
    "d04_signed_return_edge", lambda s, d: edge.signed_return_edge(*edge_tables(s, d)),
    SIGNALS + RETURNS + BASE + LABELS + """, g AS (SELECT *, CASE WHEN action = 'BUY' THEN fwd ELSE -fwd END AS signed FROM lab)
    SELECT horizon, agent, COUNT(*) AS n, ROUND(AVG(signed), 6) AS mean_signed, ROUND(SKEWNESS(signed), 6) AS skew,
           ROUND(ABS(AVG(signed) FILTER (signed > 0) / AVG(signed) FILTER (signed < 0)), 6) AS win_loss, ROUND(ANY_VALUE(base_mean), 6) AS passive_mean
    FROM g JOIN base USING (horizon) GROUP BY horizon, agent""",
)
add(
    "d05_calibration", lambda s, d: edge.calibration(*edge_tables(s, d)),
    SIGNALS + RETURNS + LABELS + """ SELECT agent, CAST(CASE WHEN confidence < 0.55 THEN 0 WHEN confidence < 0.65 THEN 0.55 WHEN confidence < 0.75 THEN 0.65 WHEN confidence < 0.85 THEN 0.75 ELSE 0.85 END AS DOUBLE) AS bin,
    COUNT(*) AS n, COUNT(DISTINCT date) AS n_dates, ROUND(AVG(confidence), 6) AS mean_conf, ROUND(AVG(hit), 6) AS hit_rate FROM lab WHERE horizon = 5 AND confidence < 1.01 GROUP BY 1, 2""",
)
add("d06_reliability", lambda s, d: edge.reliability(_signals(s, d, ["long_short_trend"]), _returns(s, d)),
    SIGNALS + RETURNS + LABELS + """, r AS (SELECT * FROM lab WHERE horizon = 5 AND agent = 'long_short_trend'),
    q AS (SELECT agent, LIST_SORT(LIST_DISTINCT(QUANTILE_CONT(confidence, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM r GROUP BY agent HAVING COUNT(*) >= 10),
    b AS (SELECT r.*, GREATEST(1, LEN(LIST_FILTER(e, lambda x: x < confidence))) AS bucket FROM r JOIN q USING (agent) WHERE LEN(e) >= 3)
    SELECT agent, CAST(bucket AS INT) AS bucket, COUNT(*) AS n, ROUND(AVG(hit), 6) AS hit, ROUND(QUANTILE_CONT(confidence, 0.5), 6) AS median_conf FROM b GROUP BY 1, 2""")  # fmt: skip
add("d11_regime_excess", lambda s, d: edge.regime_excess(*edge_tables(s, d), features.market_drawdown(view(s, d, "bars").where("symbol = 'S1'"))),
    SIGNALS + RETURNS + f""", dd AS (SELECT date, 1 - close / ({guarded('MAX', 'close', 252, 60)}) AS x FROM bars WHERE symbol = 'S1'),
    bk AS (SELECT date, CASE WHEN x < 0.05 THEN '0-5' WHEN x < 0.1 THEN '5-10' WHEN x < 0.2 THEN '10-20' ELSE '20+' END AS bucket FROM dd WHERE x IS NOT NULL),
    al AS (SELECT fw.*, bucket FROM fw JOIN bk USING (date) WHERE horizon = 5 AND fwd IS NOT NULL), bs AS (SELECT bucket, AVG(fwd) AS b FROM al GROUP BY 1),
    ow AS (SELECT agent, bucket, COUNT(*) AS n, AVG(al.fwd) AS m FROM signals JOIN al USING (symbol, date) WHERE action = 'BUY' GROUP BY 1, 2)
    SELECT agent, bucket, n, ROUND(CASE WHEN n >= 50 THEN m - b END, 6) AS excess FROM ow JOIN bs USING (bucket)""")  # fmt: skip
_MIX = "((((({x} * 16807 + 12345) % 2147483647) * (({x} * 16807 + 12345) % 2147483647) + 7) % 2147483647) * 48271 + 1) % 2147483647".replace("{x}", "((draw * 48271 + part * 69621 + {seed}) % 2147483647)")


def bootstrap_sql(source: str, by: str, block: str, sums: dict[str, str], seed: int, draws: int = 2000) -> str:
    """CTEs ending in ``boot`` (by, draw, n, sums): every row of every resample is fetched on its own."""
    same = " AND ".join(f"o.{c} = nb.{c}" for c in by.split(", "))
    return f"""o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY date) - 1 AS i, COUNT(*) OVER (PARTITION BY {by}) AS n FROM {source}),
    gr AS (SELECT DISTINCT {by}, n, {block} AS block FROM o), pt AS (SELECT *, UNNEST(GENERATE_SERIES(0, CAST(CEIL(n / block) AS BIGINT) - 1)) AS part FROM (SELECT *, UNNEST(GENERATE_SERIES(0, {draws - 1})) AS draw FROM gr)),
    sr AS (SELECT *, {_MIX.replace("{seed}", str(seed))} % n AS start FROM pt), nb AS (SELECT *, UNNEST(GENERATE_SERIES(0, LEAST(block, n - part * block) - 1)) AS step FROM sr),
    boot AS (SELECT {", ".join("nb." + c for c in by.split(", "))}, draw, ANY_VALUE(nb.n) AS n, {", ".join(f"SUM({c}) AS {k}" for k, c in sums.items())} FROM nb JOIN o ON {same} AND o.i = (nb.start + nb.step) % nb.n GROUP BY ALL)"""


add("d09_excess_intervals", lambda s, d: edge.excess_intervals(*edge_tables(s, d)),
    SIGNALS + RETURNS + BASE + LABELS + """, dy AS (SELECT agent, horizon, date, COUNT(*) AS n_rows, ROUND(SUM(hit) - SUM(CASE WHEN action = 'BUY' THEN base_buy ELSE base_sell END), 9) AS gap FROM lab JOIN base USING (horizon) GROUP BY 1, 2, 3),
    """ + bootstrap_sql("dy", "agent, horizon", "horizon", {"gap": "gap", "n_in": "n_rows"}, 1) + """,
    q AS (SELECT agent, horizon, QUANTILE_CONT(gap / n_in, 0.025) AS low, QUANTILE_CONT(gap / n_in, 0.975) AS high FROM boot WHERE n >= 2 GROUP BY 1, 2), e AS (SELECT agent, horizon, COUNT(*) AS n_dates, SUM(gap) / SUM(n_rows) AS excess FROM dy GROUP BY 1, 2)
    SELECT agent, horizon, n_dates, ROUND(excess, 6) AS excess, ROUND(low, 6) AS low, ROUND(high, 6) AS high, CASE WHEN n_dates < 60 THEN 'insufficient' WHEN low > 0 THEN 'edge' WHEN high < 0 THEN 'anti-edge' ELSE 'indistinguishable' END AS verdict FROM e LEFT JOIN q USING (agent, horizon)""")  # fmt: skip
_SCORE = ", ".join(f"{back('close', 21)} / {back('close', 21 + p)} - 1" for p in (63, 126, 252))
SCORES = f", sc AS (SELECT symbol, date, LIST_AVG(LIST_FILTER([{_SCORE}], lambda x: x IS NOT NULL)) AS mom_score, LN(LEAD(close, 20) {_P} / close) AS fwd_20 FROM bars)"
add("f01_momentum_ranks", lambda s, d: ranking.momentum_ranks(features.momentum_score(view(s, d, "bars"))),
    duck("bars") + SCORES + """, r AS (SELECT *, COUNT(*) OVER (PARTITION BY date) AS n, ROW_NUMBER() OVER (PARTITION BY date ORDER BY mom_score DESC, symbol) AS rank FROM sc WHERE mom_score IS NOT NULL),
    t AS (SELECT *, CAST(GREATEST(1, CEIL(n * 0.25)) AS BIGINT) AS top_n FROM r WHERE n >= 4)
    SELECT date, symbol, rank, n, ROUND_EVEN(rank / n, 4) AS pct_rank, CASE WHEN rank <= top_n THEN 'BUY' ELSE 'HOLD' END AS action,
           CASE WHEN rank <= top_n THEN ROUND_EVEN(LEAST(0.90::DOUBLE, 0.65::DOUBLE + 0.15::DOUBLE * (top_n - rank) / GREATEST(top_n - 1, 1)), 3) ELSE 0.3 END::DOUBLE AS confidence FROM t""", ("date",))  # fmt: skip
add("f02_long_short_spread", lambda s, d: ranking.long_short_spread(features.forward_returns(features.momentum_score(view(s, d, "bars"))), "mom_score", "fwd_20", least=8),
    duck("bars") + SCORES + """, r AS (SELECT *, COUNT(*) OVER (PARTITION BY date) AS n, ROW_NUMBER() OVER (PARTITION BY date ORDER BY -mom_score, symbol) AS r FROM sc WHERE mom_score IS NOT NULL AND fwd_20 IS NOT NULL)
    SELECT date, n, ROUND(AVG(fwd_20) FILTER (r <= k) - AVG(fwd_20) FILTER (r > n - k), 6) AS spread FROM (SELECT *, GREATEST(1, CAST(FLOOR(n * 0.1) AS INT)) AS k FROM r WHERE n >= 8) GROUP BY date, n""", ("date",))  # fmt: skip
_SPREAD = SCORES + """, r AS (SELECT *, COUNT(*) OVER (PARTITION BY date) AS n, ROW_NUMBER() OVER (PARTITION BY date ORDER BY -mom_score, symbol) AS r FROM sc WHERE mom_score IS NOT NULL AND fwd_20 IS NOT NULL),
    sd AS (SELECT date, CASE WHEN date < DATE '1995-01-01' THEN 'early' ELSE 'late' END AS period, ROUND(AVG(fwd_20) FILTER (r <= k) - AVG(fwd_20) FILTER (r > n - k), 9) AS spread FROM (SELECT *, GREATEST(1, CAST(FLOOR(n * 0.1) AS INT)) AS k FROM r WHERE n >= 8) GROUP BY date, n)"""


def _spread(s, d):
    rows = ranking.long_short_spread(features.forward_returns(features.momentum_score(view(s, d, "bars")), (20,)), "mom_score", "fwd_20", least=8)
    return rows.select("date", F.when(F.col("date") < "1995-01-01", "early").otherwise("late").alias("period"), F.round("spread", 9).alias("spread"))


add("d10_spread_intervals", lambda s, d: edge.mean_interval(written(_spread(s, d), "spread"), "spread", ["period"], 20),
    duck("bars") + _SPREAD + ", " + bootstrap_sql("sd", "period", "20", {"total": "spread"}, 1) + """, q AS (SELECT period, QUANTILE_CONT(total / n, 0.025) AS low, QUANTILE_CONT(total / n, 0.975) AS high FROM boot GROUP BY 1), e AS (SELECT period, COUNT(*) AS n, AVG(spread) AS mean FROM sd GROUP BY 1 HAVING COUNT(*) >= 30)
    SELECT period, n, ROUND(mean, 6) AS mean, ROUND(low, 6) AS low, ROUND(high, 6) AS high, CASE WHEN low > 0 THEN 'positive' WHEN high < 0 THEN 'negative' ELSE 'none' END AS verdict FROM e JOIN q USING (period)""")  # fmt: skip
_SCORED = ", scored AS (SELECT *, ROUND(confidence * CASE WHEN action = 'HOLD' THEN 0.05 ELSE GREATEST(target_weight, 0.05) END, 9) AS score FROM signals)"
_WON = ", won AS (SELECT * FROM scored WHERE TRUE QUALIFY ROW_NUMBER() OVER (PARTITION BY date, symbol ORDER BY score DESC, action = 'BUY' DESC, agent_ord) = 1), win AS (SELECT * FROM won WHERE score >= 0.02)"
add("f04_arena_winner", lambda s, d: ranking.arena_winner(edge_tables(s, d)[0]).select("symbol", "date", "agent", "action", "score"), SIGNALS + _SCORED + _WON + " SELECT symbol, date, agent, action, ROUND(score, 6) AS score FROM win", ("date",))
add("f05_corroboration", lambda s, d: (lambda said: ranking.corroborated(ranking.arena_winner(said), said))(edge_tables(s, d)[0]).groupBy("agent", "action").agg(F.count("*").alias("n")),
    SIGNALS + _SCORED + _WON + """, v AS (SELECT s.date, s.symbol, COUNT(*) AS active, COUNT_IF(s.action = w.action) AS sup, COUNT_IF(s.action <> w.action AND s.action <> 'HOLD') AS opp
    FROM signals s JOIN win w ON s.date = w.date AND s.symbol = w.symbol WHERE s.confidence > 0.25 GROUP BY 1, 2)
    SELECT agent, action, COUNT(*) AS n FROM win w WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.date = w.date AND v.symbol = w.symbol AND active >= 2 AND sup <= 1 AND opp > active / 2) GROUP BY 1, 2""")  # fmt: skip
add("d33_exposure", lambda s, d: ranking.exposure(_signals(s, d)), SIGNALS + """ SELECT COUNT_IF(target_weight > 0) AS n_long, COUNT_IF(target_weight < 0) AS n_short, COUNT_IF(target_weight = 0) AS n_flat,
    ROUND(SUM(ABS(target_weight)), 6) AS gross, ROUND(SUM(target_weight), 6) AS net FROM signals""")  # fmt: skip
