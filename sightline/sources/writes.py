"""Tables that are written: replaced lists, upserts and inserts that return what they inserted.

Every write replaces whole partitions by Spark's dynamic overwrite, so nothing changes before its job
commits: a write that fails leaves the old table, and one that is repeated leaves the same table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sightline.sources.tables import read_or_empty


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share. Only a session of one machine may name none."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", given)
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def overwrite_parts(rows: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that ``rows`` has, and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def with_part(schema: StructType, part: str, kind: str) -> StructType:
    return StructType([f for f in schema.fields if f.name != part]).add(part, kind)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merged(old: DataFrame, new: DataFrame, key: str, order: str, keep_old: bool) -> DataFrame:
    """One row for each key: the one of the greatest ``order``, the new one among equals. With ``keep_old`` each
    column has its latest value that is not null. Both are maxima, so tasks reduce a hot key before the shuffle."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    columns = [c for c in old.columns if c != key]
    if not keep_old:
        best = both.groupBy(key).agg(F.max(F.struct(order, "__new", *(c for c in columns if c != order))).alias("best"))
        return best.select(key, *(F.col(f"best.{c}").alias(c) for c in columns))
    latest = (F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), "__new", F.col(c).alias("v")))).getField("v").alias(c) for c in columns)
    return both.groupBy(key).agg(*latest)


def upsert(rows: DataFrame, path: str, key: str, order: str, keep_old: bool = False, buckets: int = 64) -> None:
    """Merges ``rows`` into the table at ``path``, which is partitioned by a hash of ``key``: only buckets with
    incoming keys are read and written, each by one task (choose ``buckets`` so that one fits). Rows without a key are no rows of the table."""
    new = rows.filter(F.col(key).isNotNull())
    part = bucket_of(key, buckets)
    touched = [r[0] for r in new.select(part.alias("b")).distinct().collect()]
    if touched:
        old = read_or_empty(rows.sparkSession, path, with_part(rows.schema, "bucket", "integer")).filter(F.col("bucket").isin(touched)).drop("bucket")
        overwrite_parts(merged(old, new, key, order, keep_old).withColumn("bucket", part).repartition("bucket"), path, "bucket")


def insert_absent(rows: DataFrame, path: str, key: str, batch: int) -> DataFrame:
    """Inserts the rows whose key is not stored and returns them. A batch that is repeated inserts and returns
    the same rows, so that what depends on them can be repeated too. Of incoming rows with one key one is taken."""
    spark, schema = rows.sparkSession, with_part(rows.schema, "batch", "long")
    known = read_or_empty(spark, path, schema).filter(F.col("batch") < batch).select(key)
    one = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*(c for c in rows.columns if c != key))).alias("one")).select(key, "one.*")
    overwrite_parts(one.join(known, key, "left_anti").select(*rows.columns, F.lit(batch).cast("long").alias("batch")), path, "batch")
    return read_or_empty(spark, path, schema).filter(F.col("batch") == batch).drop("batch")


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, keep_old: bool = False) -> StreamingQuery:
    """Upserts what has arrived, batch by batch; a batch repeated after a failure changes nothing."""
    return _each(stream, checkpoint, lambda rows, _: upsert(rows, path, key, order, keep_old))


def _each(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_source(spark: SparkSession, folder: str, columns: list[str], like: StructType, key: str, cursor: str, path: str) -> None:
    """Takes in what is new in ``folder`` (a path or a pattern) since the last run. Spark's file log in ``path`` knows the files that were
    read; their rows whose key is not stored yet are stored, once, and each batch leaves its counts and the greatest
    ``cursor`` so far in the log: batch, discovered, created, skipped, cursor."""

    def take(rows: DataFrame, batch: int) -> None:
        rows = rows.select(*columns)
        created = insert_absent(rows, f"{path}/items", key, batch).count()
        found = rows.agg(F.count(key).alias("discovered"), F.max(cursor).alias("cursor"))
        told = found.select(F.lit(batch).cast("long").alias("batch"), "discovered", F.lit(created).cast("long").alias("created"), (F.col("discovered") - created).alias("skipped"), "cursor")
        overwrite_parts(told, f"{path}/log", "batch")

    _each(spark.readStream.schema(like).parquet(folder), f"{path}/checkpoint", take).awaitTermination()


def sync_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/log", f"discovered long, created long, skipped long, cursor {kind}, batch long")
