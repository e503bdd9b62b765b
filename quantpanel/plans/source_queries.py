"""Nested source documents made of the tables' rows and flattened again, factor tables and weighted votes, with their SQL on the rows themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantpanel.operators import ranking
from quantpanel.sources import lake

from .common import Catalog, duck, view
from .log_queries import _DAY

CATALOG = Catalog()
add = CATALOG.add
C = F.col


def _orders(s, d):
    return s.read.parquet(f"{d}/orders.parquet").withColumn("ticker", F.concat(F.lit("S"), (C("o_custkey") % 50).cast("string")))


def _facts_json(s, d):
    """A document for each ticker: tag -> units -> observations, some of them without a date, in a unit that is not wanted or under an unknown tag."""
    k = C("o_orderkey")
    tag = F.when(k % 11 == 0, "Unknown").when(C("o_orderstatus") == "F", "NetIncomeLoss").when(C("o_orderstatus") == "O", "ProfitLoss").otherwise("Assets")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    seen = F.struct(day.alias("start"), F.when(k % 7 != 0, day).otherwise("soon").alias("end"), C("o_totalprice").alias("val"), F.when(k % 5 != 0, day).alias("filed"), F.lit("10-K").alias("form"), (k % 30 + 1990).cast("int").alias("fy"), F.lit("FY").alias("fp"))
    rows = _orders(s, d).select("ticker", tag.alias("tag"), F.when(k % 13 == 0, "EUR").otherwise("USD").alias("unit"), seen.alias("o"))
    units = rows.groupBy("ticker", "tag", "unit").agg(F.collect_list("o").alias("obs")).groupBy("ticker", "tag").agg(F.map_from_entries(F.collect_list(F.struct("unit", "obs"))).alias("units"))
    return units.groupBy("ticker").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("units"))))).alias("json"))


_CONCEPTS = [("net_income", "NetIncomeLoss", 0), ("net_income", "ProfitLoss", 1), ("assets", "Assets", 0)]
add(
    "a07_flatten_facts", lambda s, d: lake.flatten_facts(_facts_json(s, d), s.createDataFrame(_CONCEPTS, "metric string, tag string, tag_rank int")).groupBy("ticker", "metric", "tag_rank").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("period_end").alias("first_end"), F.max("fiscal_year").alias("last_year")),
    """WITH o AS (SELECT 'S' || (o_custkey % 50) AS ticker, CASE o_orderstatus WHEN 'F' THEN 'net_income' WHEN 'O' THEN 'net_income' ELSE 'assets' END AS metric, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS tag_rank, o_totalprice AS v, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k FROM orders)
    SELECT ticker, metric, tag_rank, COUNT(*) AS n, ROUND(SUM(v), 2) AS total, MIN(day) AS first_end, CAST(MAX(k % 30 + 1990) AS INT) AS last_year FROM o WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 7 <> 0 AND k % 5 <> 0 GROUP BY ALL""", ("first_end",), 2,
)


def _form4(s, d):
    """A filing for each order, a transaction for each of its lines; fields as elements or as text."""
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))

    def tx(r):
        k = r["l_partkey"]
        held = lambda n, v: F.when(k % 2 == 0, tag(n, tag("value", v))).otherwise(tag(n, v))
        price = F.when(k % 5 == 0, "").otherwise(held("price", r["l_extendedprice"].cast("decimal(18,2)").cast("string")))
        return tag("nonDerivativeTransaction", F.concat(held("date", r["l_shipdate"].cast("date").cast("string")), held("code", F.when(k % 3 == 0, "P").otherwise("S")), held("acquired", F.when(k % 4 == 0, "D").otherwise("A")), held("shares", F.when(k % 17 == 0, "many").otherwise(r["l_quantity"].cast("int").cast("string"))), price))

    # lines travel as numbers and become text where their filing is
    lines = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")).alias("lines"))
    rows = lines.select("l_orderkey", F.array_join(F.transform("lines", tx), "").alias("txs"))
    key = C("l_orderkey")
    owner = F.concat(tag("name", F.concat(F.lit("R"), (key % 9).cast("string"))), tag("isOfficer", F.when(key % 3 == 0, "1").otherwise("0")), tag("isDirector", F.when(key % 2 == 0, "true").otherwise("false")))
    return rows.select(F.concat(F.lit("<filing>"), tag("issuer", F.concat(F.lit("S"), (key % 50).cast("string"))), tag("reportingOwner", owner), "txs", F.lit("</filing>")).alias("xml"))


add(
    "a08_flatten_insider", lambda s, d: lake.flatten_insider_xml(_form4(s, d)).groupBy("ticker", "reporter_name").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"), F.round(F.sum("total_value"), 2).alias("total"), F.max("transaction_date").alias("latest")),
    """WITH t AS (SELECT 'S' || (l_orderkey % 50) AS ticker, 'R' || (l_orderkey % 9) AS reporter_name, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS sh, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18, 2)) END AS px, CAST(l_shipdate AS DATE) AS day FROM lineitem
    WHERE (l_orderkey % 3 = 0 OR l_orderkey % 2 = 0) AND l_partkey % 3 = 0 AND l_partkey % 4 <> 0 AND l_partkey % 17 <> 0)
    SELECT ticker, reporter_name, COUNT(*) AS n, SUM(sh) AS shares, ROUND(SUM(CAST(sh AS DECIMAL(18, 0)) * px), 2)::DOUBLE AS total, MAX(day) AS latest FROM t GROUP BY 1, 2""", ("latest",),
)


def _filings(s, d):
    """Parallel arrays of each user's events; the array of dates is short of one entry for some."""
    rows = s.read.parquet(f"{d}/events.parquet").groupBy(F.concat(F.lit("U"), C("user_id").cast("string")).alias("ticker")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", F.to_date("ts").cast("string").alias("day")))).alias("e"))
    short = F.when(F.size("e") % 2 == 0, F.slice("e", F.lit(1), F.size("e") - 1)).otherwise(C("e"))
    return rows.select("ticker", C("e")["event_type"].alias("form"), F.transform("e", lambda x: x["event_id"].cast("string")).alias("accession"), F.transform(short, lambda x: x["day"]).alias("filed"))


add(
    "a09_zip_filings", lambda s, d: lake.zip_filings(_filings(s, d), "purchase"),
    """WITH e AS (SELECT 'U' || user_id AS ticker, event_type, event_id, CAST(ts AS DATE) AS day, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS k, COUNT(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT ticker, CAST(event_id AS VARCHAR) AS accession, day AS filed FROM e WHERE event_type = 'purchase' AND (n % 2 = 1 OR k < n)""", ("filed",),
)


def _percent(s, d, name, lo):
    """Percent returns of the symbols whose number leaves ``lo`` by four; a date now and then lacks one."""
    rows = view(s, d, "bars").where((F.substring("symbol", 2, 9).cast("int") % 4) == lo)
    return rows.groupBy("date").agg(F.when(F.dayofyear("date") % 31 != 0, 100 * (F.avg("close") / F.avg("open") - 1)).alias(name))


add(
    "a10_factor_table", lambda s, d: lake.factor_table(_percent(s, d, "mkt", 0).join(_percent(s, d, "smb", 1), "date"), _percent(s, d, "mom", 2)),
    duck("bars") + """, p AS (SELECT date, CAST(SUBSTR(symbol, 2) AS INT) % 4 AS k, AVG(close) / AVG(open) - 1 AS r FROM bars GROUP BY 1, 2)
    SELECT a.date, ROUND(a.r, 6) AS mkt, ROUND(b.r, 6) AS smb, ROUND(c.r, 6) AS mom FROM p a JOIN p b ON b.date = a.date AND b.k = 1 JOIN p c ON c.date = a.date AND c.k = 2 WHERE a.k = 0 AND DAYOFYEAR(a.date) % 31 <> 0""", ("date",),
)


def _weights(s, d):
    """By the agent's number, one without influence, one unknown."""
    agents = view(s, d, "decisions").select("agent").distinct().where("agent <> 'A5'")
    return agents.withColumn("weight", F.substring("agent", 2, 1).cast("double") / 2)


add(
    "k03_weighted_consensus", lambda s, d: ranking.consensus(view(s, d, "decisions").withColumn("day", F.to_date("timestamp")), _weights(s, d)).select("day", "symbol", "eligible", "speaking", "score", "conviction", "action"),
    duck("decisions") + f""", v AS (SELECT {_DAY} AS day, symbol, CASE action WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END AS dir, CASE agent WHEN 'A5' THEN 1.0 ELSE CAST(SUBSTR(agent, 2) AS DOUBLE) / 2 END::DOUBLE AS w FROM decisions WHERE agent <> 'A0'),
    g AS (SELECT day, symbol, COUNT(*) AS eligible, COUNT_IF(dir <> 0) AS speaking, COALESCE(SUM(dir * w) / NULLIF(SUM(CASE WHEN dir <> 0 THEN w END), 0), 0) AS score FROM v GROUP BY 1, 2), c AS (SELECT *, ABS(score) * SQRT(speaking / eligible) AS conviction FROM g)
    SELECT day, symbol, eligible, speaking, ROUND(score, 6) AS score, ROUND(conviction, 6) AS conviction, CASE WHEN conviction < 0.15 THEN 'NONE' WHEN score > 0 THEN 'BUY' ELSE 'SELL' END AS action FROM c""", ("day",),
)
