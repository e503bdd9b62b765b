"""Statistics per group that no built-in aggregate gives; each group is a short series, handled by numpy inside a task."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.blocks import in_blocks, pairs_of_blocks
from quantpanel.operators.risk import tail_closes
from quantpanel.sources.scratch import written

C = F.col
MIN_ROWS = 60
# MacKinnon (2010) response surface, two variables with a constant, 5 % and 10 % (c0 + c1/T + c2/T^2).
CRITICAL = {5: (-3.33613, -6.1101, -6.823), 10: (-3.04445, -4.2412, -2.720)}


def binomial_tail(k: int, n: int) -> float:
    """P(X >= k) for X ~ Binomial(n, 1/2), from logarithms of the terms."""
    if n <= 0:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(max(k, 0), n + 1)]
    return float(min(1.0, sum(map(math.exp, terms))))


def significance(counts: DataFrame) -> DataFrame:
    """counts (…, n, hits, n_dates) -> p_value of better than a coin, and a verdict: dates first, then signals, then p."""

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(a), int(b)) for a, b in zip(k, n)])

    rows = counts.withColumn("p_value", tail(F.coalesce("hits", F.lit(0)), "n"))
    verdict = F.when(C("n_dates") < 60, "few dates").when(C("n") < 30, "few signals").when(C("p_value") < 0.05, "edge").otherwise("no edge")
    return rows.withColumn("verdict", verdict)


def newey_west(y: np.ndarray, x: np.ndarray) -> dict:
    """Least squares with a constant in the first column and heteroskedasticity- and autocorrelation-robust errors."""
    t, k = x.shape
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    lags = max(1, int(4 * (t / 100) ** (2 / 9)))
    xe = x * e[:, None]
    s = xe.T @ xe
    for lag in range(1, lags + 1):
        g = xe[lag:].T @ xe[:-lag]
        s += (1 - lag / (lags + 1)) * (g + g.T)
    se = np.sqrt(np.maximum(np.diag(inverse @ s @ inverse), 0))
    total = ((y - y.mean()) ** 2).sum()
    r2 = 1 - (e @ e) / total if total > 0 else 0.0
    tv = np.divide(beta, se, out=np.zeros(k), where=se > 0)
    sd = e.std(ddof=k)
    return {"beta": beta, "t": tv, "p": [math.erfc(abs(v) / math.sqrt(2)) for v in tv], "r2": r2, "adj_r2": 1 - (1 - r2) * (t - 1) / max(t - k, 1), "resid_vol": sd * math.sqrt(252), "n": t}


#: Lags of a series of up to a million dates.
MOST_LAGS = 31


def regression_rows(returns: DataFrame, factors: DataFrame, names: list[str], by: str = "agent") -> DataFrame:
    """(by, date, y, x): excess returns and the regressors, a constant first."""
    rows = returns.join(factors, "date").select(by, "date", (C("ret") - C("rf")).alias("y"), *names).na.drop()
    return rows.select(by, "date", "y", F.array(F.lit(1.0), *(C(n).cast("double") for n in names)).alias("x"))


def regression_moments(rows: DataFrame, k: int, by: str = "agent") -> DataFrame:
    """Per group of ``regression_rows``: n, distinct returns, mean and square sum of y, and the normal equations xx (k x k, by rows) and xy."""
    xx = F.array(*(F.sum(C("x")[i] * C("x")[j]) for i in range(k) for j in range(k)))
    xy = F.array(*(F.sum(C("x")[i] * C("y")) for i in range(k)))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(F.round("y", 12)).alias("n_distinct"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count("*")).alias("total"), xx.alias("xx"), xy.alias("xy"))


def factor_regressions(returns: DataFrame, factors: DataFrame, names: list[str], by: str = "agent") -> DataFrame:
    """returns (by, date, ret) on factors (date, names.., rf): alpha and betas with Newey-West errors, long by term. Groups under 60 rows or 60 distinct returns are refused.

    The normal equations are sums over a group. Residuals then meet their own past within a window of ``MOST_LAGS`` rows, weighted by the
    triangle of the group's number of lags, and sums again make the covariance of the scores. Only k x k figures of a group are solved in numpy.
    """
    k, solved = len(names) + 1, "beta array<double>, inverse array<double>"
    rows = written(regression_rows(returns, factors, names, by), "regression-rows")
    moments = regression_moments(rows, k, by).where((C("n") >= MIN_ROWS) & (C("n_distinct") >= MIN_ROWS))

    @F.pandas_udf(solved)
    def solve(xx: pd.Series, xy: pd.Series) -> pd.DataFrame:
        inverses = [np.linalg.pinv(np.array(a, float).reshape(k, k)) for a in xx]
        return pd.DataFrame({"beta": [i @ np.array(b, float) for i, b in zip(inverses, xy)], "inverse": [i.ravel() for i in inverses]})

    fits = moments.withColumn("fit", solve("xx", "xy")).withColumn("lags", F.greatest(F.lit(1), F.floor(4 * F.pow(C("n") / 100, F.lit(2 / 9))).cast("int"))).select(by, "n", "total", "lags", "fit.*")
    dot = sum((C("x")[i] * C("beta")[i] for i in range(k)), F.lit(0.0))
    scores = rows.join(fits.select(by, "beta", "lags"), by).withColumn("e", C("y") - dot).select(by, "date", "e", "lags", F.transform("x", lambda v: v * C("e")).alias("u"))
    past = F.reverse(F.collect_list("u").over(W.partitionBy(by).orderBy("date").rowsBetween(-MOST_LAGS, -1)))
    scores = scores.withColumn("past", past).withColumn("past", F.slice("past", F.lit(1), C("lags")))
    triangle = lambda j: F.transform("past", lambda u, l: u[j] * (1 - (l + 1) / (C("lags") + 1)))
    weighted = [F.aggregate(triangle(j), F.lit(0.0), lambda a, v: a + v) for j in range(k)]
    scores = scores.withColumn("v", F.array(*weighted))
    sums = lambda a: F.array(*(F.sum(C("u")[i] * C(a)[j]) for i in range(k) for j in range(k)))
    errors = scores.groupBy(by).agg(sums("u").alias("own"), sums("v").alias("lagged"), F.sum(C("e") * C("e")).alias("sse"), F.avg("e").alias("e_mean"))

    @F.pandas_udf("array<struct<term: string, coef: double, t: double, p: double>>")
    def judge(beta: pd.Series, inverse: pd.Series, own: pd.Series, lagged: pd.Series) -> pd.Series:
        out = []
        for b, i, o, m in zip(beta, inverse, own, lagged):
            i, o, m = (np.array(a, float).reshape(k, k) for a in (i, o, m))
            se = np.sqrt(np.maximum(np.diag(i @ (o + m + m.T) @ i), 0))
            t = np.divide(b, se, out=np.zeros(k), where=se > 0)
            out.append([{"term": n, "coef": float(c), "t": float(v), "p": math.erfc(abs(v) / math.sqrt(2))} for n, c, v in zip(["alpha", *names], b, t)])
        return pd.Series(out)

    both = fits.join(errors, by)
    r2 = F.when(C("total") > 0, 1 - C("sse") / C("total")).otherwise(0.0)
    spread = F.sqrt((C("sse") - C("n") * C("e_mean") * C("e_mean")) / (C("n") - k)) * math.sqrt(252)
    both = both.select(by, "n", r2.alias("r2"), (1 - (1 - r2) * (C("n") - 1) / F.greatest(C("n") - k, F.lit(1))).alias("adj_r2"), spread.alias("resid_vol"), F.explode(judge("beta", "inverse", "own", "lagged")).alias("f"))
    return both.select(by, "f.term", "f.coef", "f.t", "f.p", "r2", "adj_r2", "resid_vol", "n")


def factor_verdict(fits: DataFrame, by: str = "agent") -> DataFrame:
    """Sign of a significant alpha and the significant factor with the largest beta."""
    sig = C("p") < 0.05
    alpha = F.max(F.when((C("term") == "alpha") & sig, C("coef")))
    top = F.max_by("term", F.abs("coef")).alias("x")
    factor = fits.where((C("term") != "alpha") & sig).groupBy(by).agg(top).withColumnRenamed("x", "dominant")
    out = fits.groupBy(by).agg(alpha.alias("a")).join(factor, by, "left")
    return out.select(by, F.when(C("a") > 0, "true alpha").when(C("a") < 0, "negative alpha").otherwise("no alpha").alias("verdict"), "dominant")


def hurst(x: np.ndarray) -> float | None:
    """Half the slope of log variance of lagged differences on log lag; 50 values and 4 lags at least."""
    n = len(x)
    if n < 50:
        return None
    lags = np.unique(np.geomspace(10, n // 4, 12).astype(int)) if n // 4 > 10 else np.zeros(0, int)
    pts = [(math.log(k), math.log(v)) for k in lags if (v := np.var(x[k:] - x[:-k], ddof=1)) > 0]
    return float(np.polyfit(*zip(*pts), 1)[0] / 2) if len(pts) >= 4 else None


def half_life(s: np.ndarray) -> float | None:
    """Of the reversion of 20 values at least; a series that never moves has none."""
    if len(s) < 20 or (s == s[0]).all():
        return None
    b = np.polyfit(s[:-1], np.diff(s), 1)[0]
    return float(math.log(2) / -b) if b < 0 else None


def engle_granger(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(hedge ratio, t statistic of the residual's reversion)."""
    a, b = a - a.mean(), b - b.mean()  # equal series have a ratio of 1 to the last bit, and nothing that reverts
    beta = a @ b / (b @ b) if (b @ b) > 1e-20 else 0.0
    e = a - beta * b
    x, y = np.column_stack([e[1:-1], np.diff(e)[:-1]]), np.diff(e)[1:]
    inverse = np.linalg.pinv(x.T @ x)
    c = inverse @ x.T @ y
    r = y - x @ c
    se = math.sqrt(max(r @ r / max(len(y) - 2, 1) * inverse[0, 0], 1e-300))
    return float(beta), float(c[0] / se)


def critical_value(level: int, t: int) -> float:
    c = CRITICAL[level]
    return c[0] + c[1] / t + c[2] / t**2


def sketch_candidates(bars: DataFrame, groups: DataFrame, days: int = 504, bits: int = 128, band: int = 8, seed: int = 5) -> DataFrame:
    """(a, b), a < b: pairs of a group (symbol, sector) whose last log prices move alike, by banded sign sketches.

    Bit k of a symbol is the sign of its centred log prices summed with a plus or minus drawn for (k, date), so two symbols agree on a
    bit with odds 1 - angle / pi. Symbols that share ``band`` bits in a row are candidates: what moves together meets in some band, what does not
    seldom does, and no symbol is set against all others. A cointegrated pair with a positive ratio moves together; returns alone need not show it.
    Symbols without a change of price have no sketch.
    """
    bands = _sketches(bars, days, bits, band, seed).join(groups.select("symbol", "sector"), "symbol").select("symbol", "sector", F.posexplode("codes").alias("band", "code"))
    other = bands.withColumnRenamed("symbol", "b")
    return bands.withColumnRenamed("symbol", "a").join(other, ["sector", "band", "code"]).where("a < b").select("a", "b").distinct()


def _sketches(bars: DataFrame, days: int, bits: int, band: int, seed: int) -> DataFrame:
    """(symbol, codes): the bands of each symbol that has a sketch."""
    rows = tail_closes(bars, days).select("symbol", "date", F.log("close").alias("p"))
    rows = rows.withColumn("p", C("p") - F.avg("p").over(W.partitionBy("symbol")))
    draws = [F.xxhash64(F.lit(seed + k), "date").alias(f"h{k}") for k in range(-(-bits // 64))]
    rows = rows.select("symbol", "p", *draws)
    sign = lambda k: F.when(F.getbit(C(f"h{k // 64}"), F.lit(k % 64)) == 1, C("p")).otherwise(-C("p"))
    sums = rows.groupBy("symbol").agg(F.max(F.abs("p")).alias("widest"), *(F.sum(sign(k)).alias(f"s{k}") for k in range(bits))).where("widest > 0")
    codes = [sum((F.when(C(f"s{b + i}") > 0, 1 << i).otherwise(0) for i in range(band)), F.lit(0)) for b in range(0, bits - band + 1, band)]
    return sums.select("symbol", F.array(*codes).alias("codes"))


def _pair_tests(a: np.ndarray, b: np.ndarray, lengths: tuple[int, ...]) -> tuple:
    """(beta, half_life, hurst, crossings, valid, reasons, score) of two series of log prices on the dates that they share."""
    reasons, passed, beta, life, h, crossings = [], 0, None, None, None, 0
    if len(a) < min(lengths):
        reasons.append("short")
    else:
        for n in lengths:
            if len(a) >= n:
                ratio, t = engle_granger(a[-n:], b[-n:])
                passed += t < critical_value(5, n) and ratio > 0
        if passed < 2:
            reasons.append("not cointegrated")
        tests = [engle_granger(a[k : k + 252], b[k : k + 252])[1] for k in range(0, len(a) - 251, 21)]
        if tests and np.mean([t > critical_value(10, 252) for t in tests]) > 0.2:
            reasons.append("unstable")
        beta = engle_granger(a, b)[0]
        s = a - beta * b
        life, h = half_life(s), hurst(s)
        side = s - s.mean() >= 0
        crossings = int((side[1:] != side[:-1]).sum())
        if life is None or not 5 <= life <= 60:
            reasons.append("half-life")
        if h is None or h >= 0.5:
            reasons.append("hurst")
        if crossings < 12:
            reasons.append("crossings")
    return beta, life, h, crossings, not reasons, ", ".join(reasons), int(passed)


def _log_prices(bars: DataFrame) -> DataFrame:
    """(symbol, days, logs) by date."""
    x = bars.select("symbol", F.struct(F.unix_date("date").alias("day"), F.log("close").alias("p")).alias("x")).where("x.p IS NOT NULL")
    return x.groupBy("symbol").agg(F.array_sort(F.collect_list("x")).alias("x")).select("symbol", C("x.day").alias("days"), C("x.p").alias("logs"))


TESTED = "a string, b string, beta double, half_life double, hurst double, crossings long, valid boolean, reasons string, score int"
#: What ``_pair_tests`` says of a pair that shares too few dates.
SHORT = (None, None, None, 0, False, "short", 0)
#: Symbols of a block of ``validate_pairs``: two blocks' prices take some tens of MB.
PAIR_BLOCK = 1000


def validate_pairs(bars: DataFrame, pairs: DataFrame, lengths: tuple[int, ...] = (126, 252, 504), groups: DataFrame | None = None, block: int = PAIR_BLOCK) -> DataFrame:
    """Candidate pairs (a, b): cointegration in at least two windows with a positive ratio, rolling failures at most a fifth, half-life 5 to 60, Hurst under one half, 12 crossings; all reasons listed.

    Symbols are dealt to blocks, those of a group of ``groups`` (symbol, sector) to blocks of their own. A pair travels as two names to the two blocks
    of its symbols, and a symbol's prices once to each two blocks that hold a pair of it, not once a pair. Pairs without a shared date have no row.
    """
    series = written(_log_prices(bars), "log-prices")
    own = series.select("symbol", F.lit("").alias("sector")) if groups is None else series.select("symbol").join(groups.groupBy("symbol").agg(F.min("sector").alias("sector")), "symbol", "left").na.fill("", ["sector"])
    blocks = own.groupBy("sector").agg(F.ceil(F.count("*") / block).alias("blocks"))
    own = written(own.join(F.broadcast(blocks), "sector").select("symbol", F.concat_ws("/", "sector", F.pmod(F.xxhash64("symbol"), C("blocks"))).alias("block")), "pair-blocks")
    dealt = pairs.select("a", "b").join(own.toDF("a", "p"), "a").join(own.toDF("b", "q"), "b").select("a", "b", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    dealt = written(dealt, "dealt-pairs")
    prices = dealt.select("p", "q", "a").union(dealt.select("p", "q", "b")).toDF("u", "v", "symbol").distinct().join(series, "symbol")

    def check(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        place = {s: k for k, s in enumerate(held["symbol"])}
        days, at = np.unique(np.concatenate(held["days"].to_list() or [[]]), return_inverse=True)
        x = np.full((len(place), len(days)), np.nan)
        if len(place):
            x[np.repeat(np.arange(len(place)), held["days"].map(len)), at] = np.concatenate(held["logs"].to_list())
        have, out = ~np.isnan(x), []
        for a, b in zip(asked["a"], asked["b"]):
            i, j = place[a], place[b]
            shared = np.flatnonzero(have[i] & have[j])[-max(lengths) :]
            if len(shared):
                out.append((a, b, *_pair_tests(x[i, shared], x[j, shared], lengths)))
        return pd.DataFrame(out, columns=["a", "b", "beta", "half_life", "hurst", "crossings", "valid", "reasons", "score"])

    return dealt.groupBy("p", "q").cogroup(prices.groupBy("u", "v")).applyInPandas(check, TESTED)


def _meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of ``a`` and ``b`` that agree on a column, each two once."""
    met = np.zeros(len(a) * len(b), bool)
    for x, y in zip(a.T, b.T):
        order = np.argsort(y, kind="stable")
        low, high = (np.searchsorted(y, x, side, sorter=order) for side in ("left", "right"))
        n = high - low
        met[np.repeat(np.arange(len(x)), n) * len(b) + order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
    return np.divmod(np.flatnonzero(met), len(b))


def _block_tests(lengths: tuple[int, ...]):
    """Tests of the candidates among the pairs of two blocks of sketched symbols; how many dates a pair shares is counted in bits, only pairs that share enough are brought together."""

    def both(left, right) -> pa.RecordBatch:
        alone = left["block"] == right["block"]
        blocks = [left] if alone else [left, right]
        names = pa.concat_arrays([b["symbol"].values for b in blocks])
        sizes = np.concatenate([b["sizes"].values.to_numpy() for b in blocks])
        days = np.concatenate([b["days"].values.to_numpy() for b in blocks])
        seen = np.zeros(days.max() - days.min() + 1, bool)
        seen[days - days.min()] = True
        at = (np.cumsum(seen) - 1)[days - days.min()]
        x = np.full((len(sizes), at.max() + 1), np.nan)
        x[np.repeat(np.arange(len(sizes)), sizes), at] = np.concatenate([b["logs"].values.to_numpy() for b in blocks])
        have = ~np.isnan(x)
        codes = [b["codes"].values.flatten().to_numpy().reshape(len(b["symbol"]), -1) for b in blocks]
        i, j = _meeting(codes[0], codes[-1])
        if alone:
            i, j = i[i < j], j[i < j]
        else:
            j = j + len(codes[0])
        earlier = [set(e or ()) for b in blocks for e in b["earlier"].as_py()]
        if any(earlier):  # two symbols that share several groups are a pair of the first
            first = np.fromiter((not earlier[k] & earlier[m] for k, m in zip(i, j)), bool, len(i))
            i, j = i[first], j[first]
        order = np.empty(len(names), np.int64)
        order[np.argsort(names.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(names))
        i, j = np.where(order[i] > order[j], j, i), np.where(order[i] > order[j], i, j)
        bits = np.packbits(have, axis=1)
        shared = np.concatenate([np.zeros(0, int), *(np.bitwise_count(bits[i[k : k + 50_000]] & bits[j[k : k + 50_000]]).sum(axis=1, dtype=int) for k in range(0, len(i), 50_000))])
        i, j, shared = i[shared > 0], j[shared > 0], shared[shared > 0]
        said = [SHORT] * len(i)
        for k in np.flatnonzero(shared >= min(lengths)):
            dates = np.flatnonzero(have[i[k]] & have[j[k]])[-max(lengths) :]
            said[k] = _pair_tests(x[i[k], dates], x[j[k], dates], lengths)
        found = zip(*said) if said else [()] * len(SHORT)
        columns = [names.take(pa.array(i)), names.take(pa.array(j)), *(pa.array(v, t) for v, t in zip(found, (pa.float64(),) * 3 + (pa.int64(), pa.bool_(), pa.string(), pa.int32())))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TESTED.split(", ")])

    def run(batches):
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                yield both(left, right)

    return run


def validate_sketched(bars: DataFrame, groups: DataFrame, lengths: tuple[int, ...] = (126, 252, 504), block: int = PAIR_BLOCK, days: int = 504, bits: int = 128, band: int = 8, seed: int = 5) -> DataFrame:
    """``validate_pairs`` of the ``sketch_candidates`` of ``groups`` (symbol, sector) without a table of candidates, which grows with the square of a group.

    Symbols travel with their sketch and prices in blocks of their group. Where two blocks are read, the symbols that share a band are tested at
    once, so the disk follows the prices and the memory of a task two blocks, however many pairs there are.
    """
    series = written(_log_prices(bars), "log-prices")
    own = groups.where("sector IS NOT NULL").groupBy("symbol").agg(F.array_sort(F.collect_set("sector")).alias("sectors"))
    own = own.select("symbol", F.posexplode("sectors").alias("at", "sector"), "sectors").withColumn("earlier", F.slice("sectors", F.lit(1), C("at"))).drop("at", "sectors")
    own = written(_sketches(bars, days, bits, band, seed).join(own, "symbol"), "sketches")
    sizes = own.groupBy("sector").agg(F.ceil(F.count("*") / block).alias("blocks"))
    sizes = sizes.withColumn("first", F.sum("blocks").over(W.orderBy("sector")) - C("blocks"))
    count = sizes.agg(F.sum("blocks")).first()[0] or 1
    dealt = own.join(sizes, "sector").withColumn("block", (C("first") + F.pmod(F.xxhash64("symbol"), C("blocks"))).cast("int"))
    held = in_blocks(dealt.join(series, "symbol"), "block", count, ("days", "logs"), ("symbol", "codes", "earlier"), ("sector",), "price-blocks")
    return pairs_of_blocks(held, "sector").mapInArrow(_block_tests(lengths), TESTED)


def tradable(validated: DataFrame, least: int = 2) -> DataFrame:
    """Valid pairs as ``risk.pair_signals`` takes them: a, b, beta and the windows passed beyond ``least``."""
    return validated.where("valid").select("a", "b", "beta", F.greatest(F.lit(0), C("score") - least).alias("extra"))


def path_bootstrap(returns: DataFrame, paths: int, days: int, by: str = "agent", scale: float = 1.0, cost: float = 0.0, seed: int = 7) -> DataFrame:
    """Per group, ``paths`` resampled paths of ``days`` returns under a graded drawdown breaker (1, .5, .25, 0; level 3 stays): one row a path.

    Paths are dealt out in slices; a slice carries the group's returns once.
    """
    pool = returns.where("ret IS NOT NULL").groupBy(by).agg(F.array_sort(F.collect_list("ret")).alias("pool"))
    slices = pool.select(by, "pool", F.explode(F.sequence(F.lit(0), F.lit((paths - 1) // 1000))).alias("slice"))

    def walk(key, g: pd.DataFrame) -> pd.DataFrame:
        x, part = np.array(g["pool"].iloc[0]), int(key[1])
        ids = np.arange(part * 1000, min(paths, part * 1000 + 1000), dtype=np.uint64)
        i = ids[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(days, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)
        i = (i ^ (i >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        draws = x[((i ^ (i >> np.uint64(31))) % np.uint64(len(x))).astype(int)]
        value, peak, low, stuck, worst = np.ones(len(ids)), np.ones(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), bool), np.zeros(len(ids), int)
        for d in range(days):
            down = 1 - value / peak
            level = np.where(stuck, 3, np.select([down > 0.08, down > 0.06, down > 0.04], [3, 2, 1], 0))
            stuck |= level == 3
            worst = np.maximum(worst, level)
            m = np.array([1.0, 0.5, 0.25, 0.0])[level]
            value *= 1 + m * (scale * draws[:, d] - cost)
            peak = np.maximum(peak, value)
            low = np.maximum(low, 1 - value / peak)
        return pd.DataFrame({by: key[0], "path": ids.astype(np.int64), "total": value - 1, "max_drawdown": low, "breaker": worst})

    return slices.groupBy(by, "slice").applyInPandas(walk, f"{by} string, path long, total double, max_drawdown double, breaker int")


def path_summary(paths: DataFrame, by: str = "agent") -> DataFrame:
    q = F.percentile("total", F.array(F.lit(0.01), F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = paths.groupBy(by).agg(q.alias("q"), F.avg((C("total") > 0).cast("double")).alias("p_gain"), F.avg((C("breaker") == 3).cast("double")).alias("p_breaker"), F.count("*").alias("n"))
    tail = paths.join(F.broadcast(out.select(by, C("q")[1].alias("cut"))), by).where("total <= cut").groupBy(by).agg((-F.avg("total")).alias("cvar95"))
    return out.join(tail, by).select(by, "n", (-C("q")[1]).alias("var95"), (-C("q")[0]).alias("var99"), "cvar95", C("q")[2].alias("median"), C("q")[3].alias("p95"), "p_gain", "p_breaker")
