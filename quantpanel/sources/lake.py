"""Bar lakes, dated snapshots with manifests, nested source documents, result sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

C = F.col


def read_lakes(spark: SparkSession, *globs: str) -> DataFrame:
    """Per-symbol Parquet files (symbol = file stem); of equal (symbol, date) the last lake stays."""
    lakes = None
    for k, g in enumerate(globs):
        rows = spark.read.parquet(g).withColumn("symbol", F.regexp_extract(C("_metadata.file_name"), r"^([^.]+)\.", 1)).withColumn("lake", F.lit(k))
        lakes = rows if lakes is None else lakes.unionByName(rows, allowMissingColumns=True)
    return latest(lakes, "lake")


def latest(rows: DataFrame, priority: str) -> DataFrame:
    """Of equal (symbol, date) the row of the highest ``priority``."""
    w = W.partitionBy("symbol", "date").orderBy(F.desc(priority))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", priority)


def _six_places(x: Column) -> Column:
    """``format_string("%.6f", x)``; usual prices go the shorter way of a decimal, which rounds alike."""
    usual = (x >= 1e-6) & (x < 1e9)
    return F.when(usual, F.when(usual, x).cast("decimal(16,6)").cast("string")).otherwise(F.format_string("%.6f", x))


def checksum() -> Column:
    """16 hex digits over dates and prices to six places; volume is left out. An aggregate.

    Rows are digested one by one and two parts of their digests summed, so neither order nor number of rows matters to memory, and partial sums combine.
    """
    line = F.concat_ws("|", F.date_format("date", "yyyy-MM-dd"), *(_six_places(C(c)) for c in ("open", "high", "low", "close")))
    number = lambda at: F.conv(F.substring(F.sha2(line, 256), at, 15), 16, 10).cast("long")
    half = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("decimal(20,0)")  # noqa: E731  # 30 bits of 60 each, so that a long holds the sum of a billion rows
    part = lambda at: (half(F.shiftright(number(at), 30)) * F.lit(2**30).cast("decimal(10,0)") + half(number(at).bitwiseAND(F.lit(2**30 - 1)))).cast("string")
    return F.substring(F.sha2(F.concat_ws("|", F.count("*").cast("string"), part(1), part(16)), 256), 1, 16)


def manifest(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), checksum().alias("checksum"))


def _files(spark: SparkSession, path: str):
    """(file system, path) as Spark's own readers see them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit())


def write_snapshot(bars: DataFrame, path: str) -> int:
    """A new version of the snapshot at ``path``: bars sorted by symbol and date, and their manifest.

    The files are as many as the shuffle's partitions, not as the symbols; their statistics let a reader of one symbol skip the others.

    Both are staged under names of their own; the version exists from the moment the manifest, which names its bars, is renamed. A write that
    ends before that leaves the older versions as they are, and of two writers of one version the later fails.
    """
    spark, token = bars.sparkSession, uuid.uuid4().hex[:12]
    version = max(_versions(spark, path), default=0) + 1
    bars.repartition("symbol", F.year("date")).sortWithinPartitions("symbol", "date").write.parquet(f"{path}/bars-{token}")
    held = spark.read.parquet(f"{path}/bars-{token}")
    manifest(held).withColumn("bars", F.lit(f"bars-{token}")).write.parquet(f"{path}/_staged-{token}")
    fs, staged = _files(spark, f"{path}/_staged-{token}")
    _, final = _files(spark, f"{path}/manifest-{version}")
    if fs.exists(final) or not fs.rename(staged, final):
        raise FileExistsError(f"{path}: version {version} exists")
    return version


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, manifest) of a version, the newest complete one by default."""
    version = version or max(_versions(spark, path), default=0)
    if not version:
        raise FileNotFoundError(f"{path}: no complete snapshot")
    listed = spark.read.parquet(f"{path}/manifest-{version}")
    folder = listed.select("bars").first()
    if folder is None:
        raise FileNotFoundError(f"{path}: an empty snapshot")
    return spark.read.parquet(f"{path}/{folder.bars}").withColumn("symbol", C("symbol").cast("string")), listed.drop("bars")


def changed(listed: DataFrame, bars: DataFrame) -> DataFrame:
    """Symbols of a manifest that ``bars`` lacks or whose checksum differs."""
    now = manifest(bars).select("symbol", C("checksum").alias("now"))
    return listed.join(now, "symbol", "left").where("now IS NULL OR now <> checksum").select("symbol", "checksum", "now")


def tampered(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    bars, listed = read_snapshot(spark, path, version)
    return changed(listed, bars)


FACTS_JSON = "map<string, struct<units: map<string, array<struct<start: string, end: string, val: double, filed: string, form: string, fy: int, fp: string>>>>>"


def flatten_facts(docs: DataFrame, concepts: DataFrame) -> DataFrame:
    """docs (ticker, json: tag -> units -> observations) and concepts (metric, tag, tag_rank) -> long facts; all tags stay, ranked.

    Units USD, shares and USD/shares; observations without a filing or end date go; malformed dates count as missing.
    """
    tags = docs.select("ticker", F.explode(F.from_json("json", FACTS_JSON)).alias("tag", "body")).join(F.broadcast(concepts), "tag")
    units = tags.select("ticker", "metric", "tag", "tag_rank", F.explode("body.units").alias("unit", "obs")).where(C("unit").isin("USD", "shares", "USD/shares"))
    rows = units.select("ticker", "metric", "tag", "tag_rank", F.explode("obs").alias("o"))
    day = lambda c: C(c).try_cast("date")
    out = rows.select("ticker", "metric", "tag", "tag_rank", day("o.start").alias("period_start"), day("o.end").alias("period_end"), C("o.val").alias("value"), day("o.filed").alias("filed"), C("o.form").alias("form"), C("o.fy").alias("fiscal_year"), C("o.fp").alias("fiscal_period"))
    return out.where("filed IS NOT NULL AND period_end IS NOT NULL AND value IS NOT NULL")


_FIELD = "struct<value: string, _VALUE: string>"  # <x><value>v</value></x> or <x>v</x>
FORM4 = f"issuer string, reportingOwner struct<name: string, isOfficer: string, isDirector: string>, nonDerivativeTransaction array<struct<date: {_FIELD}, code: {_FIELD}, acquired: {_FIELD}, shares: {_FIELD}, price: {_FIELD}>>"


def flatten_insider_xml(docs: DataFrame) -> DataFrame:
    """docs (xml) -> purchases (code P, acquired A) of officers and directors; a field stands in a value element or as text; a missing price is 0, non-numeric shares go."""
    # through a generator, so that the filters below are not moved before the parse, which they would repeat
    rows = docs.select(F.explode(F.array(F.from_xml("xml", FORM4))).alias("x")).select(C("x.issuer").alias("ticker"), C("x.reportingOwner").alias("o"), F.explode("x.nonDerivativeTransaction").alias("t"))
    yes = lambda c: F.coalesce(F.lower(F.trim(C(c))).isin("1", "true"), F.lit(False))
    field = lambda c: F.trim(F.coalesce(C(f"t.{c}.value"), C(f"t.{c}._VALUE")))
    rows = rows.select("ticker", C("o.name").alias("reporter_name"), yes("o.isOfficer").alias("is_officer"), yes("o.isDirector").alias("is_director"), field("date").try_cast("date").alias("transaction_date"),
                       field("code").alias("transaction_code"), field("acquired").alias("acquired"), field("shares").try_cast("double").alias("shares"), F.coalesce(field("price").try_cast("double"), F.lit(0.0)).alias("price"))
    rows = rows.where("(is_officer OR is_director) AND transaction_code = 'P' AND acquired = 'A' AND shares IS NOT NULL")
    return rows.drop("acquired").withColumn("total_value", C("shares") * C("price"))


def zip_filings(filings: DataFrame, form: str = "4") -> DataFrame:
    """Parallel arrays form, accession, filed -> rows of one form, cut at the shortest array."""
    rows = filings.select("ticker", F.posexplode(F.arrays_zip("form", "accession", "filed")).alias("i", "f"), F.least(F.size("form"), F.size("accession"), F.size("filed")).alias("n"))
    return rows.where((C("i") < C("n")) & (C("f.form") == form)).select("ticker", "f.accession", C("f.filed").try_cast("date").alias("filed"))


def factor_table(factors_pct: DataFrame, momentum_pct: DataFrame) -> DataFrame:
    """Percent to decimal, nulls dropped, joined on date."""
    to_decimal = lambda df: df.select("date", *((C(c) / 100).alias(c) for c in df.columns if c != "date")).na.drop()
    return to_decimal(factors_pct).join(to_decimal(momentum_pct), "date")


def beta_columns(fits: DataFrame, by: str, factors: list[str]) -> DataFrame:
    """Long regression rows (by, term, coef, t, p, r2, ..) -> a row per group: alpha with its t and p, a beta_<factor> column each, and the fit's figures."""
    of = lambda term, c: F.first(F.when(C("term") == term, C(c)), ignorenulls=True)
    alpha = (of("alpha", c).alias(n) for c, n in (("coef", "alpha"), ("t", "alpha_t"), ("p", "alpha_p")))
    return fits.groupBy(by).agg(*alpha, *(of(f, "coef").alias(f"beta_{f}") for f in factors), *(F.first(c).alias(c) for c in ("r2", "adj_r2", "resid_vol", "n")))


def write_report_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header; a report has a row per agent."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str, dates: DataFrame | None = None, least: int = 60) -> bool:
    """JSON rows; refuses to replace a report by one of fewer than ``least`` dates."""
    if dates is not None and dates.select("date").distinct().count() < least:
        return False
    rows.write.mode("overwrite").json(path)
    return True
