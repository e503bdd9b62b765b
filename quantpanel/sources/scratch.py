"""Intermediate tables that several consumers read: written once to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where that is unset, in local mode alone (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


#: The JVM leaves longer methods uncompiled, and those that Spark makes of many columns in one stage are longer.
LONGEST_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: what derives from it reads the table, and lost executors do not lose it."""
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    conf = df.sparkSession.conf
    key, before = LONGEST_METHOD[0], conf.get(LONGEST_METHOD[0], None)
    conf.set(*LONGEST_METHOD)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
