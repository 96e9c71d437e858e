"""Scalar rules, retrieval and streaming."""

import datetime
import shutil

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sightline.functions import scalars
from sightline.sources.tables import only_new, read, read_jdbc, read_json, read_or_empty
from sightline.streaming import events as streaming

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("used", "limit", "percent"), [(75, 100, 75), (220, 100, 100), (10, 0, 0), (None, 100, None)])
def test_percent(spark, used, limit, percent):
    assert value(spark, scalars.bounded_percent(F.lit(used).cast("double"), F.lit(limit))) == percent


def test_scalars(spark):
    assert value(spark, scalars.half_up(F.lit(-2.5))) == -2
    assert value(spark, scalars.date_key(F.lit("2026-03-01"))) == "2026-03-01"
    assert value(spark, scalars.date_key(F.lit("junk"))) is None
    assert value(spark, scalars.nice_axis_max(F.lit(340.0))) == 500
    assert value(spark, scalars.guarded_ratio(F.lit(1), F.lit(0))) == 0
    assert value(spark, scalars.latency_text(F.lit(1234.0))) == "1.23 s"
    assert value(spark, scalars.target_tone(F.lit(3), F.lit(2), F.lit(True))) == "bad"
    assert value(spark, scalars.valid_request_id(F.lit("req_" + "0" * 24)))


def test_tables(spark):
    assert read_or_empty(spark, "/nowhere/x.parquet", "a long").count() == 0
    with pytest.raises(AnalysisException):
        read_or_empty(spark, f"{SF}/events.parquet", "a no_type")
    new = spark.createDataFrame([(1,), (2,), (2,)], "a long")
    assert [r.a for r in only_new(new, spark.createDataFrame([(1,)], "a long"), "a").collect()] == [2]


def test_json_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "v": "x"}\n{"id": "no", "v": "y"}\n{broken\n{"v": "z"}\n{"id": 2}\n')
    assert sorted((r.id, r.v) for r in read_json(spark, str(tmp_path), "id long, v string", ("id",)).collect()) == [(1, "x"), (2, None)]
    assert read_json(spark, str(tmp_path), "id long, v string", ()).count() == 5


def test_jdbc_in_parts(spark):
    url = "jdbc:derby:memory:parts;create=true"
    spark.range(100).selectExpr("id", "id * 2 AS twice").write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    parts = read_jdbc(spark, url, 'SELECT * FROM t WHERE "id" >= 10', "id", 10, 100, 5)
    assert parts.rdd.getNumPartitions() == 5 and sorted(r[0] for r in parts.collect()) == list(range(10, 100))
    assert read_jdbc(spark, url, "SELECT COUNT(*) AS n FROM t").first()[0] == 100


@pytest.mark.parametrize("form", [streaming.unique_clicks, streaming.requests_per_second, streaming.daily_trend, streaming.sessions])
def test_stream_equals_batch(spark, tmp_path, form):
    folder = tmp_path / "in"
    folder.mkdir()
    shutil.copy(f"{SF}/events.parquet", folder / "a.parquet")
    table = read(spark, SF, "events")
    mode = "append" if form is streaming.unique_clicks else "complete"
    name = f"out_{form.__name__}"
    query = form(streaming.event_stream(spark, str(folder), table)).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got, batch = spark.table(name), form(table)
    if form is streaming.unique_clicks:  # which one of equal clicks stays is open
        keys = lambda df: sorted(map(str, df.select("user_id", "props").collect()))
        assert keys(got) == keys(batch)
    else:
        assert sorted(map(str, got.collect())) == sorted(map(str, batch.select(got.columns).collect()))


def test_unique_outbound_clicks(spark, tmp_path):
    """The same clicks from a stream as from a table, whatever the order of hits within the watermark."""
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    hits = [(at(0), "/v/a/r/1/go"), (at(3), "/v/a/r/1/go"), (at(2), "/v/a/r/2/go"), (at(1), "/v/b/go"), (at(4), "/v/b/go"), (at(5), "/v/a/r/1/detail"), (at(6), "/v/a/r/1"), (at(7), "/other"), (None, "/v/c/go")]
    for part in (hits[:4], hits[4:], hits[:3]):
        spark.createDataFrame(part, "ts timestamp_ntz, path string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz, path string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming.unique_outbound_clicks(stream).writeStream.format("memory").queryName("outbound").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    told = lambda df: sorted((r.short_id, r.request_id or "", r["rank"] or 0) for r in df.collect() if r.short_id != "c")
    assert told(spark.table("outbound")) == told(streaming.unique_outbound_clicks(spark.read.parquet(str(tmp_path / "in")))) == [("a", "r", 1), ("a", "r", 2), ("b", "", 0)]
    kinds = streaming.tracking_events(spark.createDataFrame(hits, "ts timestamp_ntz, path string")).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in kinds} == {"outbound_click": 6, "page_view": 1, "redirect": 1}
