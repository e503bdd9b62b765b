import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantpanel.operators import trades
from quantpanel.sources import lake
from quantpanel.sources.fixtures import view
from quantpanel.streaming import events

from .conftest import SF


def test_snapshot_round_trip_and_tampering(spark, tmp_path):
    bars = view(spark, SF, "bars").where("symbol IN ('S1', 'S2')")
    path = f"{tmp_path}/snap"
    assert lake.write_snapshot(bars, path) == 1 and lake.tampered(spark, path).count() == 0
    louder = bars.withColumn("volume", F.col("volume") * 2)
    assert lake.manifest(louder).exceptAll(lake.manifest(bars)).count() == 0
    moved = bars.withColumn("close", F.col("close") + 0.01)
    folder = next(p for p in (tmp_path / "snap").iterdir() if p.name.startswith("bars-"))
    moved.write.mode("overwrite").partitionBy("symbol").parquet(str(folder))
    assert lake.tampered(spark, path).count() == 2
    # order and repartitioning leave the checksum alone, a repeated row does not
    assert lake.manifest(bars.orderBy(F.desc("close")).repartition(7)).exceptAll(lake.manifest(bars)).count() == 0
    assert lake.changed(lake.manifest(bars), bars.union(bars.where("symbol = 'S1'").limit(1))).select("symbol").collect()[0].symbol == "S1"
    assert [r.now for r in lake.changed(lake.manifest(bars), bars.where("symbol = 'S1'")).collect()] == [None]


def test_interrupted_snapshot_leaves_the_old_one(spark, tmp_path, monkeypatch):
    bars = view(spark, SF, "bars").where("symbol IN ('S1', 'S2')")
    path = f"{tmp_path}/snap"
    lake.write_snapshot(bars, path)
    with monkeypatch.context() as m:
        m.setattr(lake, "manifest", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            lake.write_snapshot(bars.where("symbol = 'S1'"), path)
    held, listed = lake.read_snapshot(spark, path)
    assert {r.symbol for r in listed.collect()} == {"S1", "S2"} and held.count() == bars.count()
    assert lake.write_snapshot(bars.where("symbol = 'S1'"), path) == 2
    assert [r.symbol for r in lake.read_snapshot(spark, path)[1].collect()] == ["S1"] and lake.read_snapshot(spark, path, 1)[0].count() == bars.count()
    with pytest.raises(FileNotFoundError):
        lake.read_snapshot(spark, f"{tmp_path}/none")


def test_factor_table_and_reports(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    three = spark.createDataFrame([(day, 1.0, -2.0), (day + dt.timedelta(1), None, 1.0), (day + dt.timedelta(2), 3.0, 0.0)], "date date, mkt double, smb double")
    mom = spark.createDataFrame([(day, 0.5), (day + dt.timedelta(1), 0.5)], "date date, mom double")
    assert [tuple(r) for r in lake.factor_table(three, mom).collect()] == [(day, 0.01, -0.02, 0.005)]
    fits = spark.createDataFrame([("A", t, c, c * 10, 0.01, 0.5, 0.4, 0.1, 99) for t, c in (("alpha", 0.1), ("mkt", 1.1), ("smb", -0.3))], "agent string, term string, coef double, t double, p double, r2 double, adj_r2 double, resid_vol double, n long")
    wide = lake.beta_columns(fits, "agent", ["mkt", "smb"])
    lake.write_report_csv(wide, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/csv").first()
    assert (back.agent, back.alpha, back.alpha_t, back.beta_mkt, back.beta_smb, back.n) == ("A", 0.1, 1.0, 1.1, -0.3, 99)
    assert lake.write_report(wide, f"{tmp_path}/json") and spark.read.json(f"{tmp_path}/json").count() == 1
    assert not lake.write_report(wide.limit(0), f"{tmp_path}/json", three) and spark.read.json(f"{tmp_path}/json").count() == 1


def test_lakes_keep_the_last(spark, tmp_path):
    for k, price in enumerate((1.0, 2.0)):
        folder = tmp_path / f"lake{k}"
        folder.mkdir()
        spark.createDataFrame([(dt.date(2024, 1, 1), price)], "date date, close double").toPandas().to_parquet(folder / "AAA.parquet")
    got = lake.read_lakes(spark, f"{tmp_path}/lake0/*.parquet", f"{tmp_path}/lake1/*.parquet").collect()
    assert [(r.symbol, r.close) for r in got] == [("AAA", 2.0)]


def test_nested_documents(spark):
    json = '{"Assets": {"units": {"USD": [{"end": "2020-12-31", "val": 5.0, "filed": "2021-02-01", "form": "10-K", "fy": 2020, "fp": "FY"}, {"end": "bad", "val": 1.0, "filed": "2021-02-01"}], "EUR": [{"end": "2020-12-31", "val": 9.0, "filed": "2021-02-01"}]}}, "Other": {"units": {}}}'
    docs = spark.createDataFrame([("X", json), ("Y", "no json")], "ticker string, json string")
    concepts = spark.createDataFrame([("assets", "Assets", 0)], "metric string, tag string, tag_rank int")
    assert [(r.ticker, r.metric, r.value) for r in lake.flatten_facts(docs, concepts).collect()] == [("X", "assets", 5.0)]
    tx = "<nonDerivativeTransaction><date><value>2024-01-05</value></date><code>{}</code><acquired><value>A</value></acquired><shares><value>{}</value></shares>{}</nonDerivativeTransaction>"
    xml = "<f><issuer>X</issuer><reportingOwner><name>N</name><isOfficer>1</isOfficer></reportingOwner>" + tx.format("P", "10", "<price><value>2.5</value></price>") + tx.format("P", "ten", "") + tx.format("S", "3", "") + tx.format("P", "4", "") + "</f>"
    got = lake.flatten_insider_xml(spark.createDataFrame([(xml,)], "xml string")).orderBy("shares").collect()
    assert [(r.shares, r.total_value) for r in got] == [(4.0, 0.0), (10.0, 25.0)]
    filings = spark.createDataFrame([("X", ["4", "8-K", "4"], ["a", "b"], ["2024-01-01", "2024-01-02", "2024-01-03"])], "ticker string, form array<string>, accession array<string>, filed array<string>")
    assert [r.accession for r in lake.zip_filings(filings).collect()] == ["a"]


def test_filings_are_parsed_once(spark):
    owner = "<reportingOwner><name>N</name><isOfficer>{}</isOfficer><isDirector>{}</isDirector></reportingOwner>"
    tx = "<nonDerivativeTransaction><date>2024-01-05</date><code>P</code><acquired>A</acquired><shares>{}</shares></nonDerivativeTransaction>"
    docs = ["<f><issuer>X</issuer>" + owner.format("0", "TRUE") + tx.format(1) + tx.format(2) + "</f>", "<f><issuer>X</issuer>" + owner.format("0", "0") + tx.format(3) + "</f>", "<f>" + tx.format(4) + "</f>", "<f><issuer>X", "no xml", "", None]
    docs.append("<f><issuer>Y</issuer>" + owner.format(" 1 ", "") + "</f>")
    rows = lake.flatten_insider_xml(spark.createDataFrame([(x,) for x in docs], "xml string"))
    assert sorted(r.shares for r in rows.collect()) == [1.0, 2.0]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = view(spark, SF, "bus_events")
    doubled = rows.union(rows.limit(50))
    doubled.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events.ingest(events.read_events(spark, f"{tmp_path}/in", 10), "400 days")
    got = events.run_available(stream, spark, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert got.count() == rows.count() and got.where("NOT known").count() == rows.where("severity = 'odd'").count()
    counts = events.hourly_counts(events.read_events(spark, f"{tmp_path}/in", 10), "1 hour")
    done = events.run_available(counts, spark, f"{tmp_path}/out2", f"{tmp_path}/cp2")
    batch = doubled.groupBy(F.date_trunc("hour", "ts").alias("hour"), "type", "severity").count().withColumnRenamed("count", "n")
    assert done.exceptAll(batch.select(done.columns)).count() == 0 and done.count() > 0.9 * batch.count()


def test_breaker_stream_equals_batch(spark, tmp_path):
    bars = view(spark, SF, "bars").where("symbol IN ('S1', 'S2', 'S3')").select(F.col("symbol").alias("account"), F.unix_date("date").cast("long").alias("seq"), F.col("close").alias("netliq"))
    cut = bars.agg(F.percentile_approx("seq", 0.5)).first()[0]
    bars.where(F.col("seq") <= cut).coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("account string, seq long, netliq double").parquet(f"{tmp_path}/in")
    events.run_available(events.breaker(read()), spark, f"{tmp_path}/out", f"{tmp_path}/cp")
    bars.where(F.col("seq") > cut).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = events.run_available(events.breaker(read()), spark, f"{tmp_path}/out", f"{tmp_path}/cp").select("account", "seq", "level")
    want = trades.drawdown_breaker(bars, "account", "seq").select("account", "seq", "level")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_shuffled_breaker_stream_equals_batch(spark, tmp_path):
    """Rows come up to a day late and in any order; one far row of another account lets the last ones through."""
    rng = random.Random(11)
    day = dt.datetime(2024, 1, 1)
    rows = [(a, day + dt.timedelta(hours=k), k, 100.0 + rng.gauss(0, 4) + k * 0.05) for a in ("A", "B", "C") for k in range(120)]
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rng.uniform(0, 20)))
    schema = "account string, ts timestamp, seq long, netliq double"
    batches = [late[k : k + 60] for k in range(0, len(late), 60)] + [[("Z", day + dt.timedelta(days=400), 0, 1.0)]]
    for k, part in enumerate(batches):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{k:03d}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        events.run_available(events.breaker_in_order(stream, "24 hours"), spark, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out").where("account <> 'Z'").select("account", "seq", "level")
    want = trades.drawdown_breaker(spark.createDataFrame(rows, schema), "account", "seq").select("account", "seq", "level")
    assert got.count() == len(rows) and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.where("level = 3").count() > 0
