"""Exact dedup over a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest
(partial aggregation first, so a group of copies of any size costs one row per task), anti-joined with
the index by sort-merge on the bucketed key, and the new digests are appended. Labels reach the rows
through a join that adaptive execution can split, so a hot digest does not land in one task.

Defined cases: null text counts as empty; empty texts form one group; ties on length go to the smallest
``doc_id``; repeated rows are members of one group; a row without a doc_id comes last among equals and stays only where no
other can: one of such rows is kept then, and its keep_id is null; an empty table gives an empty result and leaves the
index as it was; extra columns are ignored, whatever their names. A text whose digest an earlier batch added is a copy of that
batch's row: ``kept`` is false and ``keep_id`` names the earlier row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize


def normalized(text: Column) -> Column:
    """The text without the six ASCII white-space characters."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


class DigestIndex:
    """``digest -> keep_id``, stored at ``path`` and opened again from there by a later session."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:32]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, new: DataFrame) -> None:
        (
            new.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def dedup(self, docs: DataFrame) -> DataFrame:
        """Labels every row of ``docs`` and appends the digests that the index lacks.

        Returns doc_id, digest, keep_id, group_size (rows of this batch with the digest), kept.
        """
        keyed = materialize(
            docs.select("doc_id", F.unhex(F.sha2(normalized(F.col("text")), 256)).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("points"), F.monotonically_increasing_id().alias("row")),
            "digests",
        )
        best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
        batch = keyed.groupBy("digest").agg(F.count("*").alias("group_size"), best)
        batch = materialize(batch.select("digest", "group_size", F.col("best.doc_id").alias("first_id"), F.col("best.row").alias("first_row")), "digest-groups")
        known = self.rows().select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known")).hint("merge")
        groups = materialize(batch.join(known, "digest", "left"), "digest-known")
        self.append(batch.hint("merge").join(self.rows().select("digest"), "digest", "left_anti").withColumnRenamed("first_id", "keep_id"))
        shared = groups.where("group_size > 1 OR known")
        alone, known = F.col("group_size").isNull(), F.coalesce("known", F.lit(False))
        keep = F.when(known, F.col("known_id")).when(alone, F.col("doc_id")).otherwise(F.col("first_id"))
        first = F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(False)) | (F.col("row") == F.col("first_row"))
        return keyed.join(shared, "digest", "left").select("doc_id", "digest", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (~known & (alone | first)).alias("kept"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, fresh_path(spark, "digest-index"))
    return index.dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS points
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
"""
