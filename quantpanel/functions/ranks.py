"""Numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantpanel.sources.scratch import written


def numbered(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in ``order``, which should tell all rows apart.

    Rows are dealt to ranges of the order and written with their range; a place is that within the range and the rows of the ranges
    before. Only the ranges' sizes, one row each, are added up in one task.
    """
    held = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return held.withColumn("_within", within).join(before, "_range").withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")
