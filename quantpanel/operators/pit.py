"""Point-in-time accounting facts and index membership: only what was known on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.asof import last_before, points_inside

C = F.col
STALE_DAYS = 730


def period_kind(start: Column, end: Column) -> Column:
    """instant (no start), quarter (80-100 days), annual (350-380), else ytd."""
    days = F.datediff(end, start)
    return F.when(start.isNull(), "instant").when(days.between(80, 100), "quarter").when(days.between(350, 380), "annual").otherwise("ytd")


def as_known(facts: DataFrame, on: str) -> DataFrame:
    """Per (ticker, metric, period_end, kind) the latest filing up to ``on``; ties to the lowest tag_rank, then input order."""
    rows = facts.where(C("filed") <= F.lit(on).cast("date")).withColumn("kind", period_kind(C("period_start"), C("period_end")))
    order = W.partitionBy("ticker", "metric", "period_end", "kind").orderBy(F.desc("filed"), "tag_rank", "ordinal")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def trailing_twelve_months(known: DataFrame) -> DataFrame:
    """(ticker, metric): the sum of the last four quarters if they span 350-380 days, else the latest annual value."""
    w = W.partitionBy("ticker", "metric").orderBy("period_end")
    four = w.rowsBetween(-3, 0)
    q = known.where("kind = 'quarter'").withColumns({
        "total": F.sum("value").over(four), "n_q": F.count("value").over(four), "seen": F.max("filed").over(four),
        "span": F.datediff("period_end", F.lag("period_start", 3).over(w)), "last": F.row_number().over(W.partitionBy("ticker", "metric").orderBy(F.desc("period_end"))),
    }).where("last = 1 AND n_q = 4 AND span BETWEEN 350 AND 380")
    q = q.select("ticker", "metric", C("total").alias("q_value"), C("seen").alias("q_filed"), C("period_end").alias("q_end"))
    a = known.where("kind = 'annual'").groupBy("ticker", "metric").agg(F.max_by(F.struct("value", "filed", "period_end"), "period_end").alias("a"))
    out = known.select("ticker", "metric").distinct().join(q, ["ticker", "metric"], "left").join(a, ["ticker", "metric"], "left")
    basis = F.when(C("q_value").isNotNull(), "ttm").when(C("a").isNotNull(), "annual")
    return out.select("ticker", "metric", F.coalesce("q_value", "a.value").alias("value"), F.coalesce("q_filed", "a.filed").alias("filed"), F.coalesce("q_end", "a.period_end").alias("period_end"), basis.alias("basis")).where("basis IS NOT NULL")


def wide_frame(known: DataFrame, on: str, metrics: list[str]) -> DataFrame:
    """A row per ticker: each metric's latest value and how stale the newest period is."""
    latest = known.groupBy("ticker", "metric").agg(F.max_by("value", "period_end").alias("value"), F.max("period_end").alias("end"))
    stale = latest.groupBy("ticker").agg(F.datediff(F.lit(on).cast("date"), F.max("end")).alias("stale_days"))
    return latest.groupBy("ticker").pivot("metric", metrics).agg(F.first("value")).join(stale, "ticker")


def accruals(facts: DataFrame) -> DataFrame:
    """(ticker, period_end, accruals, available): first filing of each metric, (net income - operating cash flow) / assets, known from the last of the three filings."""
    order = W.partitionBy("ticker", "metric", "period_end").orderBy("filed", "tag_rank", "ordinal")
    first = facts.withColumn("r", F.row_number().over(order)).where("r = 1")
    names = ["net_income", "operating_cash_flow", "assets"]
    wide = first.groupBy("ticker", "period_end").pivot("metric", names).agg(F.first("value").alias("v"), F.first("filed").alias("f"))
    wide = wide.where(" AND ".join(f"{n}_v IS NOT NULL" for n in names) + " AND assets_v > 0")
    return wide.select("ticker", "period_end", ((C("net_income_v") - C("operating_cash_flow_v")) / C("assets_v")).alias("accruals"), F.greatest(*(C(f"{n}_f") for n in names)).alias("available"))


def accruals_on(panel: DataFrame, dates: DataFrame, stale_days: int = STALE_DAYS) -> DataFrame:
    """For each ranking date the ticker's latest visible period; then those too stale go.

    A ticker's rows become validity intervals that do not overlap: until a later period is available, or the row is stale.
    """
    w = W.partitionBy("ticker").orderBy("available", "period_end")
    newest = panel.withColumn("best", F.max("period_end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    newest = newest.where("best IS NULL OR period_end > best").withColumn("until", F.least(F.lead("available").over(w), F.date_add("period_end", stale_days + 1)))
    return points_inside(newest, dates, "available", "until", "date").select("date", "ticker", "period_end", "accruals")


def members_on(bars: DataFrame, membership: DataFrame) -> DataFrame:
    """Bars whose symbol belongs to the most recent membership snapshot on or before the date.

    A bar meets the newest snapshot of its own symbol by one sort, and stays while no later snapshot (of any symbol) has come. The snapshots'
    dates, at most one a calendar day, are put in order in one task.
    """
    snaps = membership.select("as_of").distinct().withColumn("until", F.lead("as_of").over(W.orderBy("as_of")))
    held = membership.select(C("ticker").alias("symbol"), "as_of").distinct().join(snaps, "as_of").withColumn("date", C("as_of"))
    seen = last_before(bars, held, "symbol", "date", F.struct("as_of", "until"), "_snap")
    return seen.where("_snap IS NOT NULL AND (_snap.until IS NULL OR date < _snap.until)").select("*", "_snap.as_of").drop("_snap")


def ever_members(membership: DataFrame, start: str, end: str) -> DataFrame:
    return membership.where(C("as_of").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("ticker").distinct()


def coverage(universe: DataFrame, available: DataFrame) -> DataFrame:
    """n_universe, n_available, n_missing, ratio (four places), missing (sorted list)."""
    rows = universe.join(available.select(C("symbol").alias("ticker")).distinct().withColumn("have", F.lit(1)), "ticker", "left")
    have = F.count("have")
    return rows.agg(F.count("*").alias("n_universe"), have.alias("n_available"), (F.count("*") - have).alias("n_missing"), F.round(F.try_divide(have, F.count("*")), 4).alias("ratio"), F.array_join(F.array_sort(F.collect_list(F.when(C("have").isNull(), C("ticker")))), ",").alias("missing"))


def left_since(membership: DataFrame, then: str) -> DataFrame:
    """Tickers of the snapshot at ``then`` that the newest one lacks."""
    newest = membership.agg(F.max("as_of").alias("as_of"))
    now = membership.join(F.broadcast(newest), "as_of").select("ticker")
    return membership.where(C("as_of") == F.lit(then).cast("date")).select("ticker").subtract(now)


def normalize_ticker(raw: Column) -> Column:
    """Trimmed, dots as dashes, upper case; null unless ASCII of 1 to 6 characters."""
    t = F.upper(F.replace(F.trim(raw), F.lit("."), F.lit("-")))
    return F.when(t.rlike(r"^[\x21-\x7E]{1,6}$"), t)


def exclude_sectors(rows: DataFrame, sectors: DataFrame, names: list[str]) -> DataFrame:
    """Unknown sectors stay."""
    return rows.join(sectors.where(C("sector").isin(names)).select("ticker"), "ticker", "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Per symbol: changed and common dates, largest relative change, first changed date, rows only in ``new``."""
    both = old.select("symbol", "date", C("close").alias("c0"), F.lit(1).alias("a")).join(new.select("symbol", "date", C("close").alias("c1"), F.lit(1).alias("b")), ["symbol", "date"], "full_outer")
    rel = F.abs(F.try_divide(C("c1") - C("c0"), C("c0")))
    common = C("a").isNotNull() & C("b").isNotNull()
    changed = F.coalesce(common & (rel > eps), F.lit(False))
    return both.groupBy("symbol").agg(
        F.count_if(changed).alias("n_changed"), F.count_if(common).alias("n_total"), F.coalesce(F.max(F.when(common, rel)), F.lit(0.0)).alias("max_abs"),
        F.min(F.when(changed, C("date"))).alias("first_changed"), F.count_if(C("a").isNull()).alias("rows_added"),
    )
