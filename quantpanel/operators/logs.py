"""Run logs, events and headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

C = F.col
# Keywords of headline categories, tested in this order.
KEYWORDS = {
    "ma": ("merger", "acquisition", "acquires", "takeover", "agreed to acquire", "agreed to merge", "agrees to buy", "going private", "tender offer", "hostile bid"),
    "guidance": ("guidance", "forecast", "outlook", "raises guidance", "lowers guidance", "reaffirms", "raises target", "lowers target"),
    "analyst": (
        "upgrade", "downgrade", "price target", " rating ", "initiates", "overweight", "underweight", "outperform", "underperform", "buy rating", "sell rating", "hold rating",
    ),
    "earnings": ("earnings", " eps", " revenue", " profit", " quarter", " q1 ", " q2 ", " q3 ", " q4 ", " beats", " misses", "results", "per share"),
}
# Categories that alert when a position is open, and funds that never do.
ALERT_CATEGORIES = ("earnings", "ma")
NO_ALERT = ("SPY", "QQQ", "TLT", "GLD", "UUP", "DBC", "IWM", "EEM", "XLK", "XLF")


def intraday_alerts(news: DataFrame, positions: DataFrame) -> DataFrame:
    """news (ticker, category, ..) of open positions (symbol, qty) in an alerting category."""
    held = positions.where(F.abs("qty") > 1e-6).select(C("symbol").alias("ticker")).distinct()
    return news.where(C("category").isin(*ALERT_CATEGORIES) & ~C("ticker").isin(*NO_ALERT)).join(held, "ticker", "left_semi")


def parsed_times(rows: DataFrame, column: str, by: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a readable timestamp, counts of unreadable ones by ``by``)."""
    read = rows.withColumn(column, F.try_to_timestamp(C(column)))
    return read.where(C(column).isNotNull()), read.where(C(column).isNull()).groupBy(by).agg(F.count("*").alias("n_dropped"))


def degraded_runs(responses: DataFrame, n_agents: int, ratio: float = 0.5, runs: DataFrame | None = None, key: tuple[str, ...] = ("plan_id",)) -> DataFrame:
    """responses (key.., agent): a run is degraded when fewer than ceil(n_agents * ratio) agents, and at least one, answered. ``runs`` (key..) lists those without an answer too."""
    rows = responses.groupBy(*key).agg(F.countDistinct("agent").alias("responders"))
    if runs is not None:
        rows = runs.select(*key).distinct().join(rows, list(key), "left").na.fill(0, ["responders"])
    return judged_runs(rows, n_agents, ratio)


def judged_runs(rows: DataFrame, n_agents: int, ratio: float = 0.5) -> DataFrame:
    """``degraded_runs`` of runs whose ``responders`` are counted."""
    return rows.withColumn("degraded", C("responders") < F.greatest(F.lit(1), F.ceil(F.lit(n_agents * ratio))))


def failure_summary(failures: DataFrame) -> DataFrame:
    """failures (agent, error, symbol): one row per agent and error."""
    return failures.groupBy("agent", "error").agg(F.countDistinct("symbol").alias("symbols"), F.count("*").alias("n"))


def migrate_decisions(old: DataFrame) -> DataFrame:
    """Legacy names ts and winner_agent; a missing is_winner is true."""
    names = {"ts": "timestamp", "winner_agent": "agent"}
    rows = old.withColumnsRenamed({a: b for a, b in names.items() if a in old.columns})
    return rows if "is_winner" in rows.columns else rows.withColumn("is_winner", F.lit(True))


def quarantine(rows: DataFrame, numeric: tuple[str, ...] = ("confidence", "target_weight")) -> tuple[DataFrame, DataFrame]:
    """(good rows with numbers, malformed rows as they came): malformed is present but no number."""
    bad = F.lit(False)
    for c in numeric:
        bad = bad | (C(c).isNotNull() & C(c).cast("string").try_cast("double").isNull())
    good = rows.where(~bad).withColumns({c: C(c).cast("string").try_cast("double") for c in numeric})
    return good, rows.where(bad)


def latest_run(decisions: DataFrame) -> DataFrame:
    """Winners of the last run in the log, by symbol; never the last of each symbol over history."""
    last = decisions.agg(F.max_by("plan_id", F.struct("timestamp", "ordinal")).alias("plan_id"))
    return decisions.where("is_winner").join(F.broadcast(last), "plan_id").orderBy("symbol")


def last_of_each(decisions: DataFrame) -> DataFrame:
    """Last decision of every symbol over the whole log."""
    return decisions.groupBy("symbol").agg(F.max_by(F.struct("agent", "action", "confidence", "regime"), F.struct("timestamp", "ordinal")).alias("x")).select("symbol", "x.*")


def freshness(rows: DataFrame, ts: str, now: str, hours: float = 72.0) -> DataFrame:
    """age_hours and fresh against the parameter ``now``; unparsable or missing times give null."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max(F.col(ts).cast("string").try_cast("timestamp")))) / 3600
    return rows.agg(age.alias("age_hours"), (age <= hours).alias("fresh"))


def run_summary(decisions: DataFrame) -> DataFrame:
    """Signed summary per run: counts, the commonest agent (first seen wins a tie), sha256 of the fields."""
    first = decisions.groupBy("plan_id", "agent").agg(F.count("*").alias("n"), F.min("ordinal").alias("seen"))
    top = first.groupBy("plan_id").agg(F.max_by("agent", F.struct("n", (-C("seen")).alias("s"))).alias("top_agent"))
    n = lambda a: F.count_if(C("action") == a)
    rows = decisions.groupBy("plan_id").agg(F.count("*").alias("n_signals"), n("BUY").alias("n_buy"), n("SELL").alias("n_sell"), n("HOLD").alias("n_hold")).join(top, "plan_id")
    return rows.withColumn("hash", signature(rows.columns))


def signature(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *(C(c).cast("string") for c in columns)), 256)


def mismatches(summary: DataFrame) -> DataFrame:
    """Rows whose hash is not that of their fields."""
    return summary.where(C("hash") != signature([c for c in summary.columns if c != "hash"]))


def headline_hash(headline: Column) -> Column:
    """First 12 hex digits of the md5 of the first 8 tokens longer than 3 characters, lower case, punctuation stripped."""
    plain = F.regexp_replace(F.lower(headline), r"[^a-z0-9\s]", "")
    tokens = F.filter(F.split(F.trim(plain), r"\s+"), lambda t: F.length(t) > 3)
    return F.substring(F.md5(F.array_join(F.slice(tokens, 1, 8), " ")), 1, 12)


def headline_category(headline: Column, native: Column) -> Column:
    h = F.concat(F.lit(" "), F.lower(headline), F.lit(" "))
    out = F
    for name, words in KEYWORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(h, F.lit(w))
        out = out.when(hit, name)
    own = F.lower(F.coalesce(native, F.lit("")))
    return out.when(F.contains(own, F.lit("earnings")) | F.contains(own, F.lit("ipo")), "earnings").when(F.contains(own, F.lit("merger")), "ma").otherwise("general")


def dedup_headlines(news: DataFrame) -> DataFrame:
    """First seen of equal fingerprints within a ticker."""
    rows = news.withColumn("fingerprint", headline_hash(C("headline")))
    return rows.withColumn("r", F.row_number().over(W.partitionBy("ticker", "fingerprint").orderBy("ordinal"))).where("r = 1").drop("r")


def dedup_across_tickers(news: DataFrame) -> DataFrame:
    """Of equal fingerprints the newest; a later one in the walk that names its own ticker replaces a keeper whose ticker it does not name."""
    rows = news.withColumn("fingerprint", headline_hash(C("headline")))
    item = F.struct(C("age_minutes").alias("age"), C("ordinal").alias("ordinal"), C("ticker").alias("ticker"), C("headline").alias("headline"))
    named = F.contains(F.upper("headline"), F.upper("ticker"))  # others can never replace a keeper
    walk = rows.groupBy("fingerprint").agg(F.min(item).alias("newest"), F.array_sort(F.collect_list(F.when(named, item))).alias("items"))
    fold = "aggregate(items, newest, (e, i) -> if(contains(upper(i.headline), upper(e.ticker)), e, i))"
    return walk.select("fingerprint", F.expr(fold).alias("k")).select("fingerprint", "k.ordinal", "k.ticker", "k.headline")


def top_news(news: DataFrame, positions: list[str], limit: int = 5, per_ticker: int = 2) -> DataFrame:
    """Scored headlines, at most two a ticker, best five (capping a ticker never changes a later choice)."""
    score = F.when(C("ticker").isin(positions), 3.0).otherwise(1.0) + F.when(C("category").isin("ma", "earnings", "guidance"), 2.0).when(C("category") == "analyst", 0.5).otherwise(0.0) + F.when(C("age_minutes") < 720, 1.0).otherwise(0.0)
    rows = news.withColumn("score", score).where("score >= 2")
    order = [F.desc("score"), "age_minutes", "ordinal"]
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("ticker").orderBy(*order))).where(C("r") <= per_ticker)
    return rows.orderBy(*order).limit(limit).drop("r")


def insider_clusters(txns: DataFrame, on: str, days: int = 30, least: float = 100_000.0) -> DataFrame:
    """Qualifying purchases (officer or director, code P, value) in the lookback, by ticker; BUY for two reporters or more."""
    day = F.lit(on).cast("date")
    rows = txns.where((C("is_officer") | C("is_director")) & (C("total_value") >= least) & (C("transaction_code") == "P") & C("transaction_date").between(F.date_sub(day, days), day))
    out = rows.groupBy("ticker").agg(F.countDistinct("reporter_name").alias("reporters"), F.sum("total_value").alias("total"), F.max("transaction_date").alias("latest"))
    conf = F.bround(F.least(F.lit(0.85), 0.60 + 0.08 * (C("reporters") - 2)), 3)
    return out.withColumn("action", F.when(C("reporters") >= 2, "BUY").otherwise("HOLD")).withColumn("confidence", F.when(C("reporters") >= 2, conf).otherwise(0.0))
