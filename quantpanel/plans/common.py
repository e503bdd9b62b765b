"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.sources.fixtures import duck, view

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, as both engines add in their own order; dates as text."""
    shown = {"double": lambda c: F.round(c, digits), "date": lambda c: F.col(c).cast("string")}
    return df.select(*(shown.get(t, F.col)(c).alias(c) for c, t in df.dtypes))


class Catalog:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None, dates: tuple[str, ...] = (), digits: int = 6) -> None:
        """``dates``: date columns of the SQL's result, shown as text."""
        self.queries[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
        if sql:
            shown = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            self.sql[name] = f"SELECT * REPLACE ({shown}) FROM (\n{sql}\n)" if dates else sql


def guarded(agg: str, x: str, n: int, least: int | None = None, back: int = 0, key: str = "symbol") -> str:
    """SQL of ``functions.panel.rolling``."""
    w = f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1 + back} PRECEDING AND {f'{back} PRECEDING' if back else 'CURRENT ROW'})"
    return f"CASE WHEN COUNT({x}) {w} >= {n if least is None else least} THEN {agg}({x}) {w} END"


def back(x: str, n: int, key: str = "symbol") -> str:
    return f"LAG({x}, {n}) OVER (PARTITION BY {key} ORDER BY date)"


__all__ = ["Catalog", "Query", "back", "duck", "guarded", "rounded", "view"]
