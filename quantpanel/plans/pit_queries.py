"""Point-in-time facts, membership and set operations, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quantpanel.operators import features, pit, ranking
from quantpanel.sources import lake
from quantpanel.sources.scratch import scratch_folder

from .common import Catalog, duck, view

CATALOG = Catalog()
add = CATALOG.add
ON = "2000-06-30"
_KIND = "CASE WHEN period_start IS NULL THEN 'instant' WHEN period_end - period_start BETWEEN 80 AND 100 THEN 'quarter' WHEN period_end - period_start BETWEEN 350 AND 380 THEN 'annual' ELSE 'ytd' END"
KNOWN = duck("facts") + f""", known AS (SELECT *, {_KIND} AS kind FROM facts WHERE filed <= DATE '{ON}'
QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, metric, period_end, {_KIND} ORDER BY filed DESC, tag_rank, ordinal) = 1)"""


def _known(s, d):
    return pit.as_known(view(s, d, "facts"), ON)


add("c04_facts_as_known", lambda s, d: _known(s, d).select("ticker", "metric", "period_end", "kind", "filed", "value"), KNOWN + " SELECT ticker, metric, period_end, kind, filed, value FROM known", ("period_end", "filed"))
add("h04_period_kind", lambda s, d: view(s, d, "facts").groupBy(pit.period_kind(F.col("period_start"), F.col("period_end")).alias("kind")).agg(F.count("*").alias("n")), duck("facts") + f" SELECT {_KIND} AS kind, COUNT(*) AS n FROM facts GROUP BY 1")
# quarters of the fixture are monthly; every third one makes a chain of quarters
_QUARTERS = "MONTH(period_end) % 3 = 0"
add(
    "c05_trailing_twelve_months", lambda s, d: pit.trailing_twelve_months(_known(s, d).where(_QUARTERS)).select("ticker", "metric", "value", "filed", "period_end", "basis"),
    KNOWN + f""", q AS (SELECT *, SUM(value) OVER w AS total, COUNT(value) OVER w AS n_q, MAX(filed) OVER w AS seen, period_end - LAG(period_start, 3) OVER (PARTITION BY ticker, metric ORDER BY period_end) AS span,
    ROW_NUMBER() OVER (PARTITION BY ticker, metric ORDER BY period_end DESC) AS last FROM known WHERE kind = 'quarter' AND {_QUARTERS} WINDOW w AS (PARTITION BY ticker, metric ORDER BY period_end ROWS 3 PRECEDING))
    SELECT ticker, metric, ROUND(total, 6) AS value, seen AS filed, period_end, 'ttm' AS basis FROM q WHERE last = 1 AND n_q = 4 AND span BETWEEN 350 AND 380""", ("filed", "period_end"),
)
add(
    "c06_wide_frame", lambda s, d: pit.wide_frame(_known(s, d), ON, ["net_income", "operating_cash_flow", "assets"]),
    KNOWN + f""" SELECT ticker, ARG_MAX(value, period_end) FILTER (metric = 'net_income') AS net_income, ARG_MAX(value, period_end) FILTER (metric = 'operating_cash_flow') AS operating_cash_flow,
    ARG_MAX(value, period_end) FILTER (metric = 'assets') AS assets, CAST(DATE '{ON}' - MAX(period_end) AS INT) AS stale_days FROM known GROUP BY ticker""",
)
ACCRUALS = duck("facts", "bars") + """, f1 AS (SELECT * FROM facts QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, metric, period_end ORDER BY filed, tag_rank, ordinal) = 1),
wide AS (SELECT ticker, period_end, MAX(value) FILTER (metric = 'net_income') AS ni, MAX(value) FILTER (metric = 'operating_cash_flow') AS cf, MAX(value) FILTER (metric = 'assets') AS a, MAX(filed) AS available, COUNT(*) AS n FROM f1 GROUP BY 1, 2),
acc AS (SELECT ticker, period_end, (ni - cf) / a AS accruals, available FROM wide WHERE n = 3 AND a > 0)"""
add("c07_accruals", lambda s, d: pit.accruals(view(s, d, "facts")), ACCRUALS + " SELECT ticker, period_end, ROUND(accruals, 6) AS accruals, available FROM acc", ("period_end", "available"))


def _ranking_dates(s, d):
    """Every fifth session."""
    from pyspark.sql import Window as W

    dates = view(s, d, "bars").select("date").distinct()
    return dates.withColumn("r", F.row_number().over(W.orderBy("date"))).where("r % 5 = 0").select("date")


_DATES = ", dates AS (SELECT date FROM (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS r FROM (SELECT DISTINCT date FROM bars)) WHERE r % 5 = 0)"
_ON = _DATES + """, seen AS (SELECT date, ticker, period_end, accruals FROM dates JOIN acc ON available <= date QUALIFY ROW_NUMBER() OVER (PARTITION BY date, ticker ORDER BY period_end DESC) = 1),
fresh AS (SELECT * FROM seen WHERE date - period_end <= 730)"""
add("c08_accruals_on_dates", lambda s, d: pit.accruals_on(pit.accruals(view(s, d, "facts")), _ranking_dates(s, d)), ACCRUALS + _ON + " SELECT date, ticker, period_end, ROUND(accruals, 6) AS accruals FROM fresh", ("date", "period_end"))
add(
    "f03_accruals_spread",
    lambda s, d: ranking.long_short_spread(pit.accruals_on(pit.accruals(view(s, d, "facts")), _ranking_dates(s, d)).withColumnRenamed("ticker", "symbol").join(features.forward_returns(view(s, d, "bars"), (20,)), ["symbol", "date"]), "accruals", "fwd_20", least=3, ascending=True),
    ACCRUALS + _ON + """, fw AS (SELECT symbol, date, LN(LEAD(close, 20) OVER (PARTITION BY symbol ORDER BY date) / close) AS fwd FROM bars),
    r AS (SELECT f.date, fwd, COUNT(*) OVER (PARTITION BY f.date) AS n, ROW_NUMBER() OVER (PARTITION BY f.date ORDER BY accruals, ticker) AS r FROM fresh f JOIN fw ON ticker = symbol AND f.date = fw.date WHERE fwd IS NOT NULL)
    SELECT date, n, ROUND(AVG(fwd) FILTER (r <= k) - AVG(fwd) FILTER (r > n - k), 6) AS spread FROM (SELECT *, GREATEST(1, CAST(FLOOR(n * 0.1) AS INT)) AS k FROM r WHERE n >= 3) GROUP BY date, n""", ("date",),
)
add(
    "c09_members_on_date", lambda s, d: pit.members_on(view(s, d, "bars"), view(s, d, "membership")).select("symbol", "date", "as_of", "close"),
    duck("bars", "membership") + """, sn AS (SELECT as_of, LEAD(as_of) OVER (ORDER BY as_of) AS until FROM (SELECT DISTINCT as_of FROM membership))
    SELECT symbol, date, as_of, close FROM bars JOIN sn ON date >= sn.as_of AND (until IS NULL OR date < until) JOIN membership m USING (as_of) WHERE m.ticker = symbol""", ("date", "as_of"),
)
add("g01_ever_members", lambda s, d: pit.ever_members(view(s, d, "membership"), "1996-01-01", "1996-06-30"), duck("membership") + " SELECT DISTINCT ticker FROM membership WHERE as_of BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'")
add(
    "g02_coverage", lambda s, d: pit.coverage(view(s, d, "membership").select("ticker").distinct(), view(s, d, "bars").where("symbol < 'S5'")),
    duck("bars", "membership") + """, u AS (SELECT DISTINCT ticker FROM membership), h AS (SELECT DISTINCT symbol FROM bars WHERE symbol < 'S5')
    SELECT COUNT(*) AS n_universe, COUNT(symbol) AS n_available, COUNT(*) - COUNT(symbol) AS n_missing, ROUND(COUNT(symbol) / COUNT(*), 4) AS ratio,
           COALESCE(STRING_AGG(CASE WHEN symbol IS NULL THEN ticker END, ',' ORDER BY ticker), '') AS missing FROM u LEFT JOIN h ON ticker = symbol""",
)
add(
    "g03_new_and_missing",
    lambda s, d: (lambda m: m.where("revision_id = 3").select("ticker").subtract(m.where("revision_id = 2").select("ticker")).withColumn("change", F.lit("new")).union(m.where("revision_id = 2").select("ticker").subtract(m.where("revision_id = 3").select("ticker")).withColumn("change", F.lit("missing"))))(view(s, d, "membership")),
    duck("membership") + """, a AS (SELECT ticker FROM membership WHERE revision_id = 2), b AS (SELECT ticker FROM membership WHERE revision_id = 3)
    SELECT ticker, 'new' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT ticker, 'missing' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
add(
    "g04_left_since", lambda s, d: (lambda m: pit.left_since(m, str(m.agg(F.min("as_of")).first()[0])))(view(s, d, "membership")),
    duck("membership") + " SELECT ticker FROM membership WHERE as_of = (SELECT MIN(as_of) FROM membership) EXCEPT SELECT ticker FROM membership WHERE as_of = (SELECT MAX(as_of) FROM membership)",
)
add(
    "b08_sector_exclusion", lambda s, d: pit.exclude_sectors(view(s, d, "membership"), view(s, d, "sectors"), ["ASIA", "EUROPE"]).groupBy("revision_id").agg(F.count("*").alias("n")),
    duck("membership", "sectors") + " SELECT revision_id, COUNT(*) AS n FROM membership LEFT JOIN sectors USING (ticker) WHERE COALESCE(sector, '') NOT IN ('ASIA', 'EUROPE') GROUP BY 1",
)
add(
    "h03_normalize_ticker", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(pit.normalize_ticker(F.concat(F.lit(" "), F.substring("c_name", 1, 4), F.lit("."), F.col("c_custkey").cast("string"))).alias("ticker")).where("ticker IS NOT NULL").distinct(),
    "SELECT DISTINCT t AS ticker FROM (SELECT UPPER(REPLACE(TRIM(' ' || SUBSTR(c_name, 1, 4) || '.' || c_custkey), '.', '-')) AS t FROM customer) WHERE LENGTH(t) BETWEEN 1 AND 6",
)
add(
    "c22_snapshot_diff",
    lambda s, d: (lambda b: pit.snapshot_diff(b.where("date < '2000-01-01'"), b.withColumn("close", F.when(F.col("volume") > 40, F.col("close") * 1.01).otherwise(F.col("close")))))(view(s, d, "bars")),
    duck("bars") + """ SELECT symbol, COUNT_IF(date < DATE '2000-01-01' AND volume > 40) AS n_changed, COUNT_IF(date < DATE '2000-01-01') AS n_total,
    ROUND(COALESCE(MAX(CASE WHEN date < DATE '2000-01-01' THEN CASE WHEN volume > 40 THEN ABS((close * 1.01::DOUBLE - close) / close) ELSE 0 END END), 0), 6) AS max_abs,
    MIN(CASE WHEN date < DATE '2000-01-01' AND volume > 40 THEN date END) AS first_changed, COUNT_IF(date >= DATE '2000-01-01') AS rows_added FROM bars GROUP BY symbol""", ("first_changed",),
)
_LINE = "STRFTIME(date, '%Y-%m-%d')" + "".join(f" || '|' || PRINTF('%.6f', {c})" for c in ("open", "high", "low", "close"))
_MANIFEST = f""", hx AS (SELECT symbol, date, SHA256({_LINE}) AS h FROM {{t}}), mf AS (SELECT symbol, COUNT(*) AS n_rows, MIN(date) AS first_date, MAX(date) AS last_date,
    SUBSTR(SHA256(COUNT(*) || '|' || SUM(CAST('0x' || SUBSTR(h, 1, 15) AS BIGINT)) || '|' || SUM(CAST('0x' || SUBSTR(h, 16, 15) AS BIGINT))), 1, 16) AS checksum FROM hx GROUP BY 1)"""
add("a03_manifest", lambda s, d: lake.manifest(view(s, d, "bars")), duck("bars") + _MANIFEST.format(t="bars") + " SELECT * FROM mf", ("first_date", "last_date"))


def _verified(s, d):
    """A written snapshot against bars in which one close moved and a symbol went."""
    path = f"{scratch_folder(s)}/snapshot-{uuid.uuid4().hex[:12]}"
    lake.write_snapshot(view(s, d, "bars"), path)
    rows, listed = lake.read_snapshot(s, path)
    moved = F.when((F.col("symbol") == "S3") & (F.month("date") == 6), F.col("close") + 0.01).otherwise(F.col("close"))
    return lake.changed(listed, rows.where("symbol <> 'S5'").withColumn("close", moved)).select("symbol", F.col("now").isNull().alias("missing"))


add("a04_tampered", _verified, "SELECT * FROM (VALUES ('S3', FALSE), ('S5', TRUE)) AS v(symbol, missing) WHERE symbol IN (SELECT 'S' || l_suppkey FROM lineitem)")
