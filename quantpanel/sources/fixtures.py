"""Canonical tables derived from the star-schema test tables, in Spark and, from the same text, for DuckDB.

Integer window sums keep both engines bit-identical. ``ADD_DAYS[d;n]`` and ``STRING`` are the only dialect marks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": (("lineitem",), """
        SELECT CONCAT('S', CAST(sk AS STRING)) AS symbol, date,
               ROUND(100*EXP(0.004*lvl)*(1 + 0.001*(tax % 9 - 4)), 6) AS open,
               ROUND(100*EXP(0.004*lvl)*(1.006 + 0.001*(tax % 5)), 6) AS high,
               ROUND(100*EXP(0.004*lvl)*(0.994 - 0.001*(tax % 3)), 6) AS low,
               ROUND(100*EXP(0.004*lvl), 6) AS close, volume
        FROM (SELECT *, SUM(CAST(disc - 5*n AS BIGINT)) OVER (PARTITION BY sk ORDER BY date) AS lvl
              FROM (SELECT l_suppkey AS sk, CAST(l_shipdate AS DATE) AS date, SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS disc,
                           COUNT(*) AS n, SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS tax, SUM(l_quantity) AS volume
                    FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)) AS d) AS w"""),
    "decisions": (("events",), """
        SELECT d.*, ROW_NUMBER() OVER (PARTITION BY plan_id, symbol ORDER BY confidence DESC, agent, ordinal) = 1 AS is_winner
        FROM (SELECT event_id AS ordinal, CONCAT('p', CAST(event_id % 500 AS STRING)) AS plan_id, ts AS timestamp,
                     CONCAT('S', CAST(user_id % 50 AS STRING)) AS symbol,
                     CASE event_id % 3 WHEN 0 THEN 'bull' WHEN 1 THEN 'bear' ELSE 'choppy' END AS regime,
                     CONCAT('A', CAST(event_id % 7 AS STRING)) AS agent,
                     CASE WHEN event_type IN ('purchase', 'signup') THEN 'BUY' WHEN event_type = 'error' THEN 'SELL' ELSE 'HOLD' END AS action,
                     CAST(event_id*37 % 101 AS DOUBLE)/CAST(100 AS DOUBLE) AS confidence,
                     CAST(event_id % 13 AS DOUBLE)/CAST(100 AS DOUBLE) AS target_weight
              FROM {events}) AS d"""),
    "executions": (("events",), """
        SELECT event_id AS ordinal, CONCAT('p', CAST(event_id % 500 AS STRING)) AS plan_id, ts AS timestamp,
               CONCAT('S', CAST(user_id % 50 AS STRING)) AS symbol,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'BUY' ELSE 'SELL' END AS side,
               CAST(1 + event_id % 20 AS DOUBLE) AS qty, 100 + value/10 AS limit_price, 100 + value/10 AS last_price,
               CASE WHEN event_id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE 100 + value/10 END AS avg_fill_price,
               CAST(event_id % 17 - 8 AS DOUBLE) AS slippage_bps
        FROM {events} WHERE event_type <> 'view'"""),
    "facts": (("orders",), """
        SELECT CONCAT('S', CAST(o_custkey % 50 AS STRING)) AS ticker,
               CASE o_orderstatus WHEN 'F' THEN 'net_income' WHEN 'O' THEN 'operating_cash_flow' ELSE 'assets' END AS metric,
               CAST(o_orderkey % 2 AS INT) AS tag_rank, LAST_DAY(CAST(o_orderdate AS DATE)) AS period_end,
               ADD_DAYS[LAST_DAY(CAST(o_orderdate AS DATE));-91] AS period_start,
               ADD_DAYS[CAST(o_orderdate AS DATE);30 + o_orderkey % 60] AS filed, o_totalprice AS value, o_orderkey AS ordinal
        FROM {orders}"""),
    "membership": (("lineitem",), """
        SELECT as_of, CONCAT('S', CAST(k AS STRING)) AS ticker, snapshot AS revision_id
        FROM (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS k FROM {lineitem}) AS s
        CROSS JOIN (SELECT i AS snapshot, ADD_DAYS[d0;90*i] AS as_of
                    FROM (SELECT MIN(CAST(l_shipdate AS DATE)) AS d0 FROM {lineitem}) AS m
                    CROSS JOIN (SELECT EXPLODE[0;29] AS i) AS n) AS t
        WHERE (k + snapshot) % 4 <> 0"""),
    "sectors": (("supplier", "nation", "region"), """
        SELECT CONCAT('S', CAST(s_suppkey AS STRING)) AS ticker, r_name AS sector
        FROM {supplier} AS s JOIN {nation} AS n ON s_nationkey = n_nationkey JOIN {region} AS r ON n_regionkey = r_regionkey"""),
    "insider": (("lineitem",), """
        SELECT CONCAT('S', CAST(l_suppkey AS STRING)) AS ticker, CONCAT('R', CAST(l_partkey % 9 AS STRING)) AS reporter_name,
               l_partkey % 3 = 0 AS is_officer, l_partkey % 2 = 0 AS is_director, CAST(l_shipdate AS DATE) AS transaction_date,
               l_quantity AS shares, l_extendedprice AS total_value, CASE WHEN l_linestatus = 'O' THEN 'P' ELSE 'S' END AS transaction_code
        FROM {lineitem} WHERE l_returnflag = 'R'"""),
    "bus_events": (("events",), """
        SELECT CAST(event_id AS STRING) AS id, ts, event_type AS type,
               CASE WHEN value > 40 THEN 'critical' WHEN value > 20 THEN 'warning' WHEN event_id % 97 = 0 THEN 'odd' ELSE 'info' END AS severity,
               CONCAT(event_type, ' ', CAST(user_id AS STRING)) AS title, props AS meta
        FROM {events}"""),
    "news": (("documents",), """
        SELECT doc_id AS ordinal, CONCAT('S', CAST(doc_id % 50 AS STRING)) AS ticker, SUBSTRING(text, 1, 80) AS headline,
               source AS native_category, doc_id % 5000 AS age_minutes
        FROM {documents} WHERE text IS NOT NULL"""),
    "equity": (("lineitem",), """
        SELECT date, 1000000 + 100.0 * SUM(CAST(CAST(day_sum AS BIGINT) AS BIGINT)) OVER (ORDER BY date) / 10 AS netliq
        FROM (SELECT CAST(l_shipdate AS DATE) AS date, SUM(CAST(ROUND(l_discount*100) - 5 AS BIGINT)) AS day_sum FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)) AS e"""),
}


def _dialect(sql: str, spark: bool) -> str:
    if spark:
        sql = re.sub(r"ADD_DAYS\[(.*?);(.*?)\]", r"DATE_ADD(\1, CAST(\2 AS INT))", sql)
        return re.sub(r"EXPLODE\[(.*?);(.*?)\]", r"EXPLODE(SEQUENCE(\1, \2))", sql)
    sql = re.sub(r"ADD_DAYS\[(.*?);(.*?)\]", r"CAST(\1 + CAST(\2 AS INTEGER) AS DATE)", sql)
    sql = re.sub(r"EXPLODE\[(.*?);(.*?)\]", r"UNNEST(RANGE(\1, \2 + 1))", sql)
    return sql.replace("AS STRING", "AS VARCHAR")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    return spark.sql(_dialect(sql, True), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def duck(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({_dialect(VIEWS[n][1], False).format(**{t: t for t in VIEWS[n][0]})})" for n in names)
