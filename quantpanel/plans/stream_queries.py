"""The streaming operators run over what is there, with SQL of the batch result.

A stream's input is written to the scratch folder; one far row lets the watermark pass all others, so that every window and row is given out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quantpanel.sources.scratch import scratch_folder
from quantpanel.streaming import events

from .common import Catalog, duck, view

CATALOG = Catalog()
add = CATALOG.add
C = F.col
FAR = "2100-01-01"


def _streamed(s, rows, made):
    """The sink's rows after ``made`` (stream -> stream) ran over ``rows``."""
    folder = f"{scratch_folder(s)}/stream-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(f"{folder}/in")
    stream = s.readStream.schema(rows.schema).parquet(f"{folder}/in")
    return events.run_available(made(stream), s, f"{folder}/out", f"{folder}/checkpoint")


def _bus(s, d):
    """Every fifth event comes twice."""
    rows = view(s, d, "bus_events")
    return rows.unionByName(rows.where(C("id").cast("long") % 5 == 0)).withColumn("ts", C("ts").cast("timestamp"))


def _far(rows):
    return rows.unionByName(rows.limit(1).withColumn("id", F.lit("far")).withColumn("ts", F.lit(FAR).cast("timestamp")))


add("l01_ingested", lambda s, d: _streamed(s, _bus(s, d), lambda x: events.ingest(x, "400 days")).groupBy("type", "known").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids")),
    duck("bus_events") + " SELECT type, severity IN ('info', 'warning', 'critical') AND type IN ('signup', 'login', 'click', 'view', 'purchase', 'error') AS known, COUNT(*) AS n, COUNT(DISTINCT id) AS n_ids FROM bus_events GROUP BY 1, 2")
add("l02_hourly_counts", lambda s, d: _streamed(s, _far(view(s, d, "bus_events")), events.hourly_counts).select(C("hour").cast("string").alias("hour"), "type", "severity", "n"),
    duck("bus_events") + " SELECT STRFTIME(DATE_TRUNC('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, type, severity, COUNT(*) AS n FROM bus_events GROUP BY 1, 2, 3")


def _curves(s, d):
    rows = view(s, d, "bars").select(C("symbol").alias("account"), C("date").cast("timestamp").alias("ts"), F.unix_date("date").cast("long").alias("seq"), C("close").alias("netliq"))
    return rows.unionByName(s.createDataFrame([("far", 0, 1.0)], "account string, seq long, netliq double").withColumn("ts", F.lit(FAR).cast("timestamp")))


add("l03_breaker_stream", lambda s, d: _streamed(s, _curves(s, d), lambda x: events.breaker_in_order(x, "1 hour")).where("account <> 'far'").select("account", "seq", "drawdown", "level"),
    duck("bars") + """, p AS (SELECT symbol AS account, date, close, MAX(close) OVER (PARTITION BY symbol ORDER BY date) AS peak FROM bars), l AS (SELECT *, 1 - close / peak AS d FROM p),
    k AS (SELECT *, CASE WHEN d > 0.08 THEN 3 WHEN d > 0.06 THEN 2 WHEN d > 0.04 THEN 1 ELSE 0 END AS v FROM l)
    SELECT account, CAST(date - DATE '1970-01-01' AS BIGINT) AS seq, ROUND(d, 6) AS drawdown, CASE WHEN MAX(v) OVER (PARTITION BY account ORDER BY date) = 3 THEN 3 ELSE v END AS level FROM k""")  # fmt: skip
