"""Sequential decisions per group: risk budget, correlation veto, single-strategy backtests. A group is one run or one (agent, symbol)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.functions.asof import points_inside
from quantpanel.functions.panel import true
from quantpanel.operators.strategies import answered

C = F.col
COST = 0.0012
FIRST_BAR, COOLDOWN, SURE = 210, 20, 0.90
METRICS = "total_return double, annual_return double, sharpe double, max_drawdown double, n_trades long, win_rate double, win_rate_ref double"


# How much of the net-long room a regime leaves.
REGIME_ROOM = {"bull_quiet": 1.00, "bull_volatile": 0.75, "sideways": 0.60, "bear": 0.35}
PLAN_COLUMNS = {"strategy": "directional", "current_qty": 0.0}
ACCOUNT_COLUMNS = {"regime": None, "sell_only": False}


@dataclass(frozen=True)
class Limits:
    """Shares of the net asset value: a name, net long, cash, gross of pairs and of trend; of the average daily volume; the least part of a plan worth trading."""

    name: float = 0.20
    net_long: float = 1.0
    cash: float = 0.30
    pairs: float = 0.30
    trend: float = 0.60
    volume: float = 0.01
    least: float = 0.25


class RunBudget:
    """What is left of one run's budgets while its plans are taken in order."""

    def __init__(self, limits: Limits, row):
        self.limits, self.nav, self.cash, self.sell_only = limits, float(row.netliq), float(row.cash), bool(row.sell_only)
        self.long = float(row.net_long) + float(row.planned_long)
        self.gross = {"market_neutral": float(row.planned_pairs), "cta_trend": float(row.planned_trend)}
        self.net_cap = limits.net_long * REGIME_ROOM.get(row.regime or "", 1.0)

    def _enter_gross(self, kind: str, cap: float, notional: float) -> tuple[bool, str]:
        if self.sell_only:
            return False, "sell only"
        if self.nav <= 0 or (self.gross[kind] + notional) / self.nav > cap:
            return False, kind
        self.gross[kind] += notional
        return True, ""

    def take(self, row) -> tuple[float, str, str]:
        """(approved quantity, outcome, what binds)."""
        qty, notional, kind = float(row.qty), float(row.notional), row.strategy
        if row.action == "HOLD":
            return qty, "approved", ""
        closes = (row.action == "SELL" and row.current_qty > 0) or (row.action == "BUY" and row.current_qty < 0)
        if kind == "cta_trend":  # opening a short is an entry too
            if closes:
                self.gross[kind] = max(0.0, self.gross[kind] - notional)
                return qty, "approved", ""
            ok, why = self._enter_gross(kind, self.limits.trend, notional)
            return (qty, "approved", "") if ok else (0.0, "rejected", why)
        if row.action == "SELL":
            if kind == "market_neutral":  # legs fund each other
                self.gross[kind] = max(0.0, self.gross[kind] - notional)
            else:
                self.long, self.cash = max(0.0, self.long - notional), self.cash + notional
            return qty, "approved", ""
        if kind == "market_neutral":
            ok, why = self._enter_gross(kind, self.limits.pairs, notional)
            return (qty, "approved", "") if ok else (0.0, "rejected", why)
        if self.sell_only:
            return 0.0, "rejected", "sell only"
        rooms = [(self.limits.name * self.nav, "name"), (self.net_cap * self.nav - self.long, "net long"), (self.cash - self.limits.cash * self.nav, "cash")]
        if row.adv > 0 and row.price > 0:
            rooms.append((self.limits.volume * row.adv * row.price, "volume"))
        allowed, why = min(rooms, key=lambda r: r[0])
        if allowed <= 0:
            return 0.0, "rejected", why
        outcome = "approved"
        if notional > allowed:
            qty = float(allowed // row.price) if row.price > 0 else 0.0
            if qty < 1 or qty * row.price < self.limits.least * notional:
                return 0.0, "rejected", why
            outcome, notional = "trimmed", qty * row.price
        self.long, self.cash = self.long + notional, self.cash - notional
        return qty, outcome, why if outcome == "trimmed" else ""


def risk_budget(plans: DataFrame, account: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """plans (run_id, symbol, action, qty, price, confidence, adv, and where there are ``strategy`` and ``current_qty``) against
    account (run_id, netliq, cash, net_long of positions without a plan, and where there are ``regime`` and ``sell_only``).

    What frees budget (SELL, HOLD, an order toward zero) passes first; the rest follow by confidence, notional (both falling), symbol. Directional
    buys are cut to what the name, the net-long room of the regime, the cash floor and the volume leave, in whole shares, or rejected under ``least`` of
    their size. Pairs (market_neutral) and trend (cta_trend) plans have gross caps of their own and leave the other budgets alone. ``sell_only``
    rejects every entry. Runs are sorted and taken row by row, so memory does not follow the size of a run.
    """
    for name, value in PLAN_COLUMNS.items():
        plans = plans if name in plans.columns else plans.withColumn(name, F.lit(value))
    for name, value in ACCOUNT_COLUMNS.items():
        account = account if name in account.columns else account.withColumn(name, F.lit(value).cast("string" if value is None else "boolean"))
    signed = F.when(C("action") == "BUY", C("qty")).when(C("action") == "SELL", -C("qty")).otherwise(0.0)
    frees = C("action").isin("SELL", "HOLD") | (F.abs(C("current_qty") + signed) < F.abs("current_qty") - 1e-9)
    run, held = W.partitionBy("run_id"), F.abs("current_qty") * C("price")
    total = lambda kind: F.sum(F.when(kind, held).otherwise(0.0)).over(run)
    rows = plans.repartition("run_id").withColumns({
        "notional": C("qty") * C("price"), "frees": frees, "planned_pairs": total(C("strategy") == "market_neutral"), "planned_trend": total(C("strategy") == "cta_trend"),
        "planned_long": total(~C("strategy").isin("market_neutral", "cta_trend") & (C("current_qty") > 0)),
    })
    rows = rows.join(account, "run_id").sortWithinPartitions("run_id", F.desc("frees"), F.desc("confidence"), F.desc("notional"), "symbol", "action")

    def walk(batches):
        run_id, budget = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if budget is None or r.run_id != run_id:
                    run_id, budget = r.run_id, RunBudget(limits, r)
                out.append((r.run_id, r.symbol, r.strategy, r.action, *budget.take(r)))
            yield pd.DataFrame(out, columns=["run_id", "symbol", "strategy", "action", "approved_qty", "outcome", "reason"])

    return rows.mapInPandas(walk, "run_id string, symbol string, strategy string, action string, approved_qty double, outcome string, reason string")


def correlation_veto(buys: DataFrame, held: DataFrame, corr: DataFrame, limit: float = 0.70) -> DataFrame:
    """buys (run_id, symbol, confidence) in order of confidence: blocked at |r| >= ``limit`` with a held name or one already approved."""
    mine = buys.join(held.groupBy("run_id").agg(F.collect_set("symbol").alias("held")), "run_id", "left")
    both = corr.select("a", "b", "corr").union(corr.select("b", "a", "corr")).where(F.abs("corr") >= limit)
    foes = both.groupBy(C("a").alias("symbol")).agg(F.collect_set("b").alias("foes"))
    rows = mine.join(foes, "symbol", "left").select("run_id", "symbol", "confidence", F.coalesce("held", F.array()).alias("held"), F.coalesce("foes", F.array()).alias("foes"))

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        g, out = g.sort_values(["confidence", "symbol"], ascending=[False, True]), []
        taken = set(g["held"].iloc[0])
        for r in g.itertuples():
            ok = not (set(r.foes) & taken)
            if ok:
                taken.add(r.symbol)
            out.append((r.run_id, r.symbol, ok))
        return pd.DataFrame(out, columns=["run_id", "symbol", "approved"])

    return rows.groupBy("run_id").applyInPandas(run, "run_id string, symbol string, approved boolean")


def wanted_pairs(buys: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs whose correlation a run asks for, a bought name with a held or another bought one; distinct within runs before runs are put together."""
    names = buys.select("run_id", "symbol").union(held.select("run_id", "symbol")).distinct()
    both = buys.select("run_id", C("symbol").alias("x")).distinct().join(names.withColumnRenamed("symbol", "y"), "run_id")
    return both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def simulate(close: np.ndarray, action: np.ndarray, confidence: np.ndarray, regime: np.ndarray, first: int = FIRST_BAR) -> tuple[np.ndarray, list[tuple[str, float]]]:
    """(equity per bar from ``first``, trades): BUY when flat, SELL when held, each after the cooldown; a bull market keeps what is not sold surely."""
    return _walk(close, np.flatnonzero(action == "BUY"), np.flatnonzero((action == "SELL") & ~((regime == "bull") & (confidence < SURE))), first)


def _walk(close: np.ndarray, buys: np.ndarray, sells: np.ndarray, first: int = 0) -> tuple[np.ndarray, list[tuple[str, float]]]:
    """``simulate`` from one trade to the next, ``buys`` and ``sells`` being the places that allow one."""
    cash, qty, ready, since, done = 100_000.0, 0, first, first, []
    equity = np.empty(max(0, len(close) - first))
    while True:
        marks = sells if qty else buys
        k = np.searchsorted(marks, ready)
        if k == len(marks):
            break
        i = marks[k]
        px = close[i]
        bought = 0 if qty else int(0.95 * cash / px)
        if not qty and not bought:
            ready = i + 1
            continue
        equity[since - first : i - first] = cash + qty * close[since:i]
        done.append(("SELL" if qty else "BUY", px))
        cash, qty, ready, since = cash + qty * px * (1 - COST) if qty else cash - bought * px * (1 + COST), bought, i + COOLDOWN, i
    equity[since - first :] = cash + qty * close[since:]
    return equity, done


def equity_metrics(equity: np.ndarray, done: list[tuple[str, float]]) -> dict:
    """Sharpe is 0 without deviation or beyond 100. win_rate pairs each SELL with its own BUY; win_rate_ref with the last BUY of the run."""
    out = dict.fromkeys((m.split()[0] for m in METRICS.split(", ")), 0.0) | {"n_trades": len(done)}
    if len(equity) > 1:
        r = equity[1:] / equity[:-1] - 1
        total, sd = equity[-1] / equity[0] - 1, r.std(ddof=1) if len(r) > 1 else 0.0
        sharpe = (r.mean() - 0.04 / 252) / sd * math.sqrt(252) if sd > 0 else 0.0
        out |= {"total_return": total, "annual_return": (1 + total) ** (252 / len(equity)) - 1, "sharpe": sharpe if abs(sharpe) <= 100 else 0.0, "max_drawdown": float((equity / np.maximum.accumulate(equity) - 1).min())}
    buys, sells = [p for s, p in done if s == "BUY"], [p for s, p in done if s == "SELL"]
    if sells:
        out |= {"win_rate": float(np.mean([s > b for b, s in zip(buys, sells)])), "win_rate_ref": float(np.mean([s > buys[-1] for s in sells]))}
    return out


def _with_closes(signals: DataFrame, features: DataFrame | None) -> DataFrame:
    """Signals with the close and regime of their row; those that carry both need no join."""
    return signals if features is None else features.select("symbol", "date", "close", "regime").join(signals, ["symbol", "date"])


def backtests(signals: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """One backtest per (agent, symbol) on precomputed signals (symbol, date, agent, action, confidence, and close and regime without ``features``)."""
    rows = _with_closes(signals, features)

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        m = equity_metrics(*simulate(g["close"].to_numpy(), g["action"].to_numpy(), g["confidence"].to_numpy(), g["regime"].to_numpy(), 0))
        return pd.DataFrame([{"agent": key[0], "symbol": key[1]} | m])

    return rows.groupBy("agent", "symbol").applyInPandas(run, f"agent string, symbol string, {METRICS}")


FORWARD = "agent string, symbol string, window int, is_sharpe double, is_return double, oos_sharpe double, oos_return double, oos_max_drawdown double, oos_n_trades long, benchmark_return double, alpha double, warning boolean"


def _window_row(agent: str, symbol: str, window: int, inside: dict, after: dict, closes: np.ndarray) -> dict:
    """Metrics of a window's two sides, and the return of its test's first close held to the last."""
    bench = float(closes[-1] / closes[0] - 1) if len(closes) else 0.0
    row = {"agent": agent, "symbol": symbol, "window": window, "is_sharpe": inside["sharpe"], "is_return": inside["total_return"], "oos_sharpe": after["sharpe"], "oos_return": after["total_return"], "oos_max_drawdown": after["max_drawdown"], "oos_n_trades": after["n_trades"], "benchmark_return": bench}
    return row | {"alpha": row["oos_return"] - bench, "warning": bool(row["is_sharpe"] > 1.5 and row["oos_sharpe"] < 0)}


def walk_forward(signals: DataFrame, features: DataFrame | None, windows: DataFrame) -> DataFrame:
    """In-sample and out-of-sample metrics per (agent, symbol, window); each window starts afresh. A warning marks IS > 1.5 with OOS < 0."""
    rows = _with_closes(signals, features)
    rows = points_inside(windows.withColumn("after", F.date_add("test_end", 1)), rows, "train_start", "after", "date", ("symbol",)).drop("after")

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        col = lambda f, c: f[c].to_numpy()
        sides = [equity_metrics(*simulate(col(f, "close"), col(f, "action"), col(f, "confidence"), col(f, "regime"), 0)) for f in (g[g["date"] <= g["train_end"]], g[g["date"] >= g["test_start"]])]
        return pd.DataFrame([_window_row(key[0], key[1], int(key[2]), *sides, g[g["date"] >= g["test_start"]]["close"].to_numpy())])

    return rows.groupBy("agent", "symbol", "window").applyInPandas(run, FORWARD)


#: Of a strategy on a bar: no signal.
SILENT = 9


def _sides(rows: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, n_bars, close, s0..) of ``strategies.decided`` rows in order that keep n_bars, close and regime: 1 where a strategy buys, -1 where it sells and a bull market does not keep it, 0 else."""
    d = lambda k: C("said")[k]["d"]
    kept = lambda k: true((C("regime") == "bull") & (d(k)["confidence"] < SURE))
    side = lambda k: F.when(~answered(k), SILENT).when(d(k)["action"] == "BUY", 1).when((d(k)["action"] == "SELL") & ~kept(k), -1).otherwise(0).cast("byte")
    return rows.select("symbol", "n_bars", "close", *(side(k).alias(f"s{k}") for k in range(len(names))))


def _histories(batches, n_strategies: int):
    """(symbol, close, sides of each strategy) of one symbol after the other, whole, from batches in order."""
    columns = ["symbol", "close", *(f"s{k}" for k in range(n_strategies))]
    rest = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        starts = batch.column("n_bars").to_numpy() == 1
        if rest is not None:
            now, starts = [np.concatenate(v) for v in zip(rest, now)], np.concatenate([np.arange(len(rest[0])) == 0, starts])
        edges = np.flatnonzero(starts)
        for low, high in zip(edges, edges[1:]):
            yield now[0][low], now[1][low:high], [v[low:high] for v in now[2:]]
        rest = [v[edges[-1] :] for v in now] if len(edges) else None
    if rest is not None:
        yield rest[0][0], rest[1], rest[2:]


def _judged(close: np.ndarray, side: np.ndarray) -> tuple[dict, np.ndarray]:
    """Metrics of one backtest over the bars with a signal, and their closes."""
    heard = side != SILENT
    close, side = close[heard], side[heard]
    return equity_metrics(*_walk(close, np.flatnonzero(side == 1), np.flatnonzero(side == -1))), close


def _in_order(rows: DataFrame, names: list[str], judge: Callable, schema: str) -> DataFrame:
    """Rows of ``judge`` (agent, symbol, close, sides) for each strategy and symbol, where the rows of ``strategies.decided`` are: none is shuffled, sorted or unfolded.

    They must be in order (``panel.in_order``) and keep n_bars, close and regime; ``names`` are the strategies in their order.
    """

    columns = [c.split() for c in schema.split(", ")]
    types = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for c, t in columns])

    def run(batches):
        out = []
        for symbol, close, sides in _histories(batches, len(names)):
            for agent, side in zip(names, sides):
                out += judge(agent, symbol, close, side)
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, types)
                out = []
        yield pa.RecordBatch.from_pylist(out, types)

    return _sides(rows, names).mapInArrow(run, schema)


def backtests_in_order(rows: DataFrame, names: list[str]) -> DataFrame:
    """``backtests`` of all rows of ``strategies.decided`` in order."""

    def judge(agent, symbol, close, side):
        return [{"agent": agent, "symbol": symbol} | _judged(close, side)[0]] if (side != SILENT).any() else []

    return _in_order(rows, names, judge, f"agent string, symbol string, {METRICS}")


def walk_forward_in_order(rows: DataFrame, names: list[str], train: int = 378, test: int = 126, step: int = 63) -> DataFrame:
    """``walk_forward`` over the windows of ``risk.walk_forward_windows``, of all rows of ``strategies.decided`` in order."""

    def judge(agent, symbol, close, side):
        out = []
        for k, start in enumerate(range(0, len(close) - train - test + 1, step)):
            middle, end = start + train, start + train + test
            if (side[start:end] != SILENT).any():
                (inside, _), (after, oos) = _judged(close[start:middle], side[start:middle]), _judged(close[middle:end], side[middle:end])
                out.append(_window_row(agent, symbol, k, inside, after, oos))
        return out

    return _in_order(rows, names, judge, FORWARD)
