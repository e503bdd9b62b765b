"""The corpus pipeline: language ID, line dedup, near dedup, mixing, packing, each stage written and read again.

Every stage works on all that its predecessor kept; all but the last return the columns of ``documents``.

Defined cases: null texts and texts without a letter have no language and go in the first stage (if no row names a language, nothing
can be learned and every text with a letter stays); texts of any length are read whole; rows that share a doc_id are one document after
near dedup, for which the longest text stands; rows without a doc_id pass near dedup, are drawn first in mixing and packed as
such; ties and repeated rows are settled alike in every run; an empty table gives empty stages; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm import language_id, line_dedup, mixing, near_dedup, packing
from quantpanel.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no letters) and those that no language claims with half the probability."""
    if docs.where("lang IS NOT NULL").isEmpty():  # nothing to learn from
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language_id.identify(docs)
    return found.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= language_id.MIN_SCORE)).select(*COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated chunks of lines; documents that consist of them alone go."""
    cut = line_dedup.dedup_lines(docs).where("text <> '' OR n_chunks_removed = 0")
    return cut.withColumn("n_chars", F.when(F.col("n_chunks_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Training and hashing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
