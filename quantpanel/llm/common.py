"""Shared helpers: the work folder, written intermediate tables, table access."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


DOCS_PER_BUCKET = 8192


def bucket_count(spark: SparkSession, n_docs: int) -> int:
    """A bucket for every ``DOCS_PER_BUCKET`` documents; small tables use the cores there are."""
    return max(1, -(-n_docs // DOCS_PER_BUCKET), min(spark.sparkContext.defaultParallelism, -(-n_docs // 256)))


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one where that is unset, in local mode alone (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries inside free their shuffle files when they end, not when the driver next collects garbage: what they wrote is all that is read later."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def write_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """A Parquet table hash-bucketed by ``key`` in the shared folder: later joins on the key leave its rows where they are."""
    spark, table_name = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    with shuffles_freed(spark):
        df.write.format("parquet").option("path", fresh_path(spark, name)).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table_name)
    return spark.table(table_name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_sample(rows: DataFrame, key: str, n_rows: int, size: int, seed: int) -> DataFrame:
    """The ``size`` rows of smallest seeded hash of ``key``; a threshold from ``n_rows`` leaves little more than those to sort, at any number of tasks."""
    h = F.xxhash64(F.lit(seed), key)
    share = min(1.0, (1.3 * size + 200) / max(n_rows, 1))
    near = rows.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    return near.orderBy(F.pmod(h, F.lit(1 << 30)), key).limit(size)
