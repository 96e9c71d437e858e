"""Written tables: replacing, merging, returning, and failures that change nothing."""

import datetime

import pytest
from pyspark.sql import functions as F

from sightline.sources.writes import insert_absent, overwrite_parts, sync_log, sync_source, upsert, upsert_stream

SCHEMA = "id long, name string, note string, version int"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    upsert(make((1, "a", "x", 0), (2, "b", "y", 0), (None, "lost", None, 0)), path, "id", "version")
    change = make((2, "c", None, 2), (2, "old", None, 1), (3, "d", None, 1))
    for _ in range(2):
        upsert(change, path, "id", "version")
    assert rows(spark.read.parquet(path), "id", "name", "note", "version") == [(1, "a", "x", 0), (2, "c", None, 2), (3, "d", None, 1)]
    upsert(make((1, None, "z", 3), (2, "late", "w", 1)), path, "id", "version", keep_old=True)
    assert rows(spark.read.parquet(path), "id", "name", "note", "version") == [(1, "a", "z", 3), (2, "c", "w", 2), (3, "d", None, 1)]
    upsert(make(), path, "id", "version")
    assert spark.read.parquet(path).count() == 3


def test_failure_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert(spark.createDataFrame([(k, "a", "x", 0) for k in range(50)], SCHEMA), path, "id", "version")
    bad = spark.createDataFrame([(k, "b", "x", 1) for k in range(50)], SCHEMA).withColumn("note", F.when(F.col("id") == 40, F.raise_error(F.lit("broken"))).otherwise("y"))
    with pytest.raises(Exception, match="broken"):
        upsert(bad, path, "id", "version")
    assert rows(spark.read.parquet(path), "name", "note") == [("a", "x")] * 50


def test_returned_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *x: spark.createDataFrame(list(x), "key string, v long")
    assert rows(insert_absent(make(("a", 1), ("a", 2), (None, 3)), path, "key", 0), "key", "v") == [("a", 1)]
    for _ in range(2):
        assert rows(insert_absent(make(("a", 9), ("b", 2)), path, "key", 1), "key", "v") == [("b", 2)]
    assert rows(insert_absent(make(("a", 9)), path, "key", 2), "key", "v") == []
    assert rows(spark.read.parquet(path), "key", "v", "batch") == [("a", 1, 0), ("b", 2, 1)]


def test_replaced_lists(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda *x: spark.createDataFrame(list(x), "v long, part string")
    overwrite_parts(make((1, "a"), (2, "a"), (3, "b")), path, "part")
    overwrite_parts(make((9, "a")), path, "part")
    assert rows(spark.read.parquet(path), "v", "part") == [(3, "b"), (9, "a")]


def test_stream_of_upserts(spark, tmp_path):
    path, folder = str(tmp_path / "t"), str(tmp_path / "in")
    for version in range(3):
        spark.createDataFrame([(k, f"n{version}", None, version) for k in range(version, 4)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        upsert_stream(stream, path, "id", "version", str(tmp_path / "c")).awaitTermination(120)
    assert rows(spark.read.parquet(path), "id", "name") == [(0, "n0"), (1, "n1"), (2, "n2"), (3, "n2")]


def test_sync_of_a_growing_folder(spark, tmp_path):
    folder, path, schema = str(tmp_path / "in"), str(tmp_path / "out"), "id long, at timestamp_ntz, more string"
    day = lambda d: datetime.datetime(2024, 1, d)
    grown = [[(1, day(1), "x"), (2, day(2), "x"), (2, day(3), "x")], [], [(2, day(4), "x"), (5, day(5), "x")]]
    for part in grown:
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        sync_source(spark, folder, ["id", "at"], spark.createDataFrame([], schema).schema, "id", "at", path)
    assert rows(sync_log(spark, path, "timestamp_ntz"), "discovered", "created", "skipped", "cursor") == [(2, 1, 1, day(5)), (3, 2, 1, day(3))]
    assert rows(spark.read.parquet(f"{path}/items"), "id") == [(1,), (2,), (5,)]
