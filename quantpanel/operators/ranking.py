"""Cross-sectional ranks, long/short spreads, arbitration between strategies, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.panel import by_date, clip, true

C = F.col


def momentum_ranks(scores: DataFrame, share: float = 0.25, least: int = 4) -> DataFrame:
    """Per date by score descending (ties by symbol); dates under ``least`` names give none. BUY for the top share."""
    rows = scores.where("mom_score IS NOT NULL")
    rows = rows.withColumn("n", F.count("*").over(by_date())).where(C("n") >= least)
    rows = rows.withColumn("rank", F.row_number().over(by_date().orderBy(F.desc("mom_score"), "symbol")))
    rows = rows.withColumn("top_n", F.greatest(F.lit(1), F.ceil(C("n") * share)).cast("long"))
    conf = F.least(F.lit(0.90), 0.65 + 0.15 * (C("top_n") - C("rank")) / F.greatest(C("top_n") - 1, F.lit(1)))
    buy = C("rank") <= C("top_n")
    return rows.select("date", "symbol", "rank", "n", F.bround(C("rank") / C("n"), 4).alias("pct_rank"), F.when(buy, "BUY").otherwise("HOLD").alias("action"), F.when(buy, F.bround(conf, 3)).otherwise(0.3).alias("confidence"))


def long_short_spread(rows: DataFrame, score: str, fwd: str, share: float = 0.10, least: int = 50, ascending: bool = False) -> DataFrame:
    """Per date: mean ``fwd`` of the best k less that of the worst k, k = max(1, int(n * share)); dates under ``least`` names are skipped."""
    rows = rows.where(C(score).isNotNull() & C(fwd).isNotNull())
    key = C(score) if ascending else -C(score)
    rows = rows.withColumn("n", F.count("*").over(by_date())).where(C("n") >= least).withColumn("r", F.row_number().over(by_date().orderBy(key, "symbol")))
    rows = rows.withColumn("k", F.greatest(F.lit(1), (C("n") * share).cast("int")))
    top, low = F.avg(F.when(C("r") <= C("k"), C(fwd))), F.avg(F.when(C("r") > C("n") - C("k"), C(fwd)))
    return rows.groupBy("date").agg(F.first("n").alias("n"), (top - low).alias("spread"))


def signal_score(priority: tuple[str, ...] = ()):
    """confidence * max(weight, .05); HOLD counts .05; a priority agent with a positive score gains .15 of its confidence. Nine places, so ties are ties."""
    s = F.when(C("action") == "HOLD", C("confidence") * 0.05).otherwise(C("confidence") * F.greatest(C("target_weight"), F.lit(0.05)))
    return F.round(s + F.when(C("agent").isin(list(priority)) & (s > 0), C("confidence") * 0.15).otherwise(0.0), 9)


def arena_winner(signals: DataFrame, priority: tuple[str, ...] = (), override: str | None = None) -> DataFrame:
    """Best signal per (date, symbol): override agent first, then score, then BUY, then agent order; none under .02."""
    rows = signals.withColumn("score", signal_score(priority))
    order = [F.desc("score"), F.desc(C("action") == "BUY"), "agent_ord"]
    if override:
        order.insert(0, F.desc(true(C("agent") == override) & (C("action") == "BUY")))
    best = rows.withColumn("r", F.row_number().over(W.partitionBy("date", "symbol").orderBy(*order))).where("r = 1")
    return best.where("score > 0 AND score >= 0.02").drop("r")


def corroborated(winners: DataFrame, signals: DataFrame, least_conf: float = 0.25) -> DataFrame:
    """Winners without those that two or more active voters leave alone: at most one supporter, over half opposed."""
    active = signals.where(C("confidence") > least_conf).join(winners.select("date", "symbol", C("action").alias("won")), ["date", "symbol"])
    votes = active.groupBy("date", "symbol").agg(F.count("*").alias("active"), F.count_if(C("action") == C("won")).alias("supporters"), F.count_if((C("action") != C("won")) & (C("action") != "HOLD")).alias("opponents"))
    veto = votes.where("active >= 2 AND supporters <= 1 AND opponents > active / 2").select("date", "symbol")
    return winners.join(veto, ["date", "symbol"], "left_anti")


def normalize_confidence(signals: DataFrame, ranges: DataFrame) -> DataFrame:
    """(conf - lo) / (hi - lo) clipped to [0, 1]; agents unknown to ``ranges`` (agent, lo, hi) or with hi <= lo stay as they are."""
    rows = signals.join(F.broadcast(ranges), "agent", "left")
    scaled = F.when(true(C("hi") > C("lo")), clip((C("confidence") - C("lo")) / (C("hi") - C("lo")), 0.0, 1.0)).otherwise(C("confidence"))
    return rows.withColumn("confidence", scaled).drop("lo", "hi")


def consensus(votes: DataFrame, weights: DataFrame | None = None, control: str | None = None, least: float = 0.15) -> DataFrame:
    """Per (day, symbol): BUY +1, SELL -1, HOLD abstains; equal weights unless given (those <= 0 are ignored).

    score = sum(direction * weight) / sum(weight); conviction = |score| * sqrt(speaking / eligible); NONE under ``least``.
    """
    rows = votes.where(C("agent") != control) if control else votes
    if weights is not None:
        rows = rows.join(F.broadcast(weights), "agent", "left").withColumn("w", F.coalesce("weight", F.lit(1.0))).where("w > 0")
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    rows = rows.withColumn("dir", F.when(C("action") == "BUY", 1).when(C("action") == "SELL", -1).otherwise(0))
    spoke = C("dir") != 0
    out = rows.groupBy("day", "symbol").agg(
        F.count("*").alias("eligible"), F.count_if(spoke).alias("speaking"),
        F.coalesce(F.try_divide(F.sum(C("dir") * C("w")), F.sum(F.when(spoke, C("w")))), F.lit(0.0)).alias("score"),
        F.array_join(F.array_sort(F.collect_set(F.when(C("dir") > 0, C("agent")))), ",").alias("buyers"),
    )
    out = out.withColumn("conviction", F.abs("score") * F.sqrt(C("speaking") / C("eligible")))
    action = F.when(C("conviction") < least, "NONE").when(C("score") > 0, "BUY").otherwise("SELL")
    return out.withColumn("action", action).withColumn("weight", F.when(C("action") == "NONE", 0.0).otherwise(0.10 * C("conviction")))


def exposure(positions: DataFrame) -> DataFrame:
    """n_long, n_short, n_flat, gross and net of a weight column."""
    w = C("target_weight")
    return positions.agg(F.count_if(w > 0).alias("n_long"), F.count_if(w < 0).alias("n_short"), F.count_if(w == 0).alias("n_flat"), F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"))
