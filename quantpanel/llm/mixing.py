"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

``source_targets`` works on one row per source: shares by weight, sources clamped at ``max_epochs`` times
their size, the excess shared again by weight until none is above. Sorted by cap per weight, the clamped
sources are a prefix, so the fixed point has a closed form over two running sums.

``mix`` then repeats each source's documents ``floor(target / size)`` whole times and takes the rest of the
target from the documents in the order of a seeded hash. The hash range is cut into about sqrt(rows)
equal buckets per source; sums per bucket (partial aggregation) find the one bucket in which the target is
reached, and only that bucket's documents are ordered. No source, however hot, is ordered in one task.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source of
size 0 has target 0; repeated rows are documents of their own and share one draw order; a null doc_id is drawn first; an empty table
gives an empty result; extra columns are kept by ``mix`` and ignored by the query; nobody is taken more than
``max_epochs`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: (source, source_size, n_docs), a row per source. Adds target and bits (of the hash buckets).

    Its windows run over the sources alone, never over documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * max_epochs
    fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    after = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(W.partitionBy())
    rows = sizes.withColumn("w", w).withColumn("cap", cap)
    rows = rows.withColumn("left", total - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(after))
    rows = rows.withColumn("open", F.col("cap") * F.col("w_left") > F.col("left") * F.col("w"))
    whole = W.partitionBy()
    level = F.max(F.when(F.col("open"), F.struct(F.col("w_left"), F.col("left")))).over(whole)
    rows = rows.withColumn("level", level)
    target = F.when(F.col("open"), (F.col("w") * F.col("level.left")).cast("double") / F.col("level.w_left").cast("double")).otherwise(F.col("cap").cast("double"))
    bits = F.ceil(F.log2(F.greatest(F.col("n_docs"), F.lit(2))) / 2).cast("int")
    return rows.select("source", "source_size", target.alias("target"), bits.alias("bits"))


def copies(sized: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, rows: DataFrame | None = None) -> DataFrame:
    """sized: (doc_id, source, size). Adds source_size, target, copies (0..max_epochs).

    ``rows``: the same rows with more columns, which are then returned with theirs; nothing is joined on doc_id.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = materialize(source_targets(per, weights, max_epochs), "mix-targets").withColumnRenamed("source", "t_source")

    def drawn(docs: DataFrame) -> DataFrame:
        draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")
        docs = docs.join(targets, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
        docs = docs.withColumn("h", F.coalesce(draw, F.lit(0))).withColumn("bucket", F.expr("shiftright(h, 60 - bits)"))
        docs = docs.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        return docs.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    running = W.partitionBy("source").orderBy("bucket")
    sums = drawn(sized).groupBy("source", "bucket").agg(F.sum("size").alias("mass"), F.first("rest").alias("rest")).withColumn("upto", F.sum("mass").over(running))
    cuts = materialize(
        sums.where("upto >= rest").groupBy("source").agg(F.min("bucket").alias("cut"), F.min(F.col("upto")).alias("upto"), F.min_by("mass", "bucket").alias("mass")).select(F.col("source").alias("c_source"), "cut", (F.col("upto") - F.col("mass")).alias("below")),
        "mix-cuts",
    )
    rows = sized if rows is None else rows
    docs = drawn(rows).join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    inside = docs.where("bucket = cut").withColumn("reached", F.col("below") + F.sum("size").over(W.partitionBy("source").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0)))
    inside = inside.withColumn("extra", (2 * F.col("reached") - F.col("size") < 2 * F.col("rest")).cast("long"))
    outside = docs.where("cut IS NULL OR bucket <> cut").withColumn("extra", (F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))).cast("long"))
    out = [*rows.columns, "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies")]
    return outside.select(*out).union(inside.select(*out))


def sized(docs: DataFrame) -> DataFrame:
    """Size of a document: its number of words (runs of anything but ASCII white space)."""
    return docs.select("doc_id", "source", _size().alias("size"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; rows that share a doc_id, or have none, each carry a count of their own."""
    sizes = materialize(sized(docs), "mix-sizes")
    text = F.struct(*docs.columns).alias("row")
    rows = docs.select("doc_id", "source", _size().alias("size"), text)
    counts = copies(sizes, seed, weights, max_epochs, rows).where("copies > 0")
    again = counts.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return again.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies(materialize(sized(docs), "mix-sizes")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || doc_id), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST)) - 1) % 3 + 1]::BIGINT AS w
  FROM d GROUP BY source),
-- rounds of clamping: (source, clamped), at most one round per source
r AS (
  SELECT 0 AS k, source, source_size, w, false AS clamped, sum(source_size) OVER ()::BIGINT AS lft, sum(w) OVER ()::BIGINT AS w_left FROM s
  UNION ALL
  SELECT k + 1, source, source_size, w, now_clamped,
         (total - sum(CASE WHEN now_clamped THEN 3 * source_size ELSE 0 END) OVER ())::BIGINT,
         sum(CASE WHEN now_clamped THEN 0 ELSE w END) OVER ()::BIGINT
  FROM (SELECT *, clamped OR 3 * source_size * w_left <= lft * w AS now_clamped, sum(source_size) OVER () AS total FROM r)
  WHERE k < 64),
t AS (SELECT source, source_size, CASE WHEN clamped THEN (3 * source_size)::DOUBLE ELSE (w * lft)::DOUBLE / w_left::DOUBLE END AS target FROM r WHERE k = 64),
m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS reached
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * reached - size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m
"""
