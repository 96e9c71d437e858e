"""Changes of tables, written and read back: each query applies them to tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.plans.report import Report
from sightline.sources.logical import jobs, query_log, users
from sightline.sources.tables import read
from sightline.sources.writes import insert_absent, overwrite_parts, sync_log, sync_source, upsert, work_dir


def profiles_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles after two batches of changes, the second of which runs twice."""
    path = work_dir(spark, "profiles")
    stored = users(spark, sf_dir).select("user_id", "name", "tier", F.lit(0).alias("version"))
    upsert(stored, path, "user_id", "version", buckets=16)
    changed = [
        stored.filter("user_id % 3 = 0").select((F.col("user_id") + 10).alias("user_id"), F.concat(F.lit("new "), "name").alias("name"), "tier", F.lit(1).alias("version")),
        stored.filter("user_id % 5 = 0").select("user_id", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("late "), "name")).alias("name"), F.lit("MOVED").alias("tier"), F.lit(2).alias("version")),
    ]
    for batch, keep_old in ((changed[0], False), (changed[1], True), (changed[1], True)):
        upsert(batch, path, "user_id", "version", keep_old, 16)
    return spark.read.parquet(path).select("user_id", "name", "tier", "version")


def signup_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonus transactions of users first seen in the first or second half of the month: a grant is inserted if
    the user has none, and a transaction only for a grant that was. The second half runs twice."""
    path = work_dir(spark, "grants")
    seen = query_log(spark, sf_dir).filter("event_type = 'signup'").groupBy("user_id", (F.col("created_at") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("late"))
    seen = seen.agg(F.min("created_at").alias("granted_at"))
    for batch, late in ((0, False), (1, True), (1, True)):
        rows = seen.filter(F.col("late") == late).select(F.concat(F.lit("signup_bonus:"), F.col("user_id").cast("string")).alias("grant_key"), "user_id", "granted_at", F.lit(100).cast("long").alias("credits"))
        returned = insert_absent(rows, f"{path}/grants", "grant_key", batch)
        insert_absent(returned.select("grant_key", "user_id", F.col("credits").alias("amount"), F.lit("grant").alias("kind")), f"{path}/transactions", "grant_key", batch)
    return spark.read.parquet(f"{path}/transactions").select("grant_key", "user_id", "amount", "kind", F.col("batch").cast("long").alias("batch"))


def targets_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of sources for two ranges; the list of one range is then replaced by a shorter one."""
    path = work_dir(spark, "targets")
    sums = jobs(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n"))
    for name, times, rows in (("7d", 1, sums), ("30d", 4, sums), ("7d", 2, sums.filter("source_id % 2 = 0"))):
        overwrite_parts(rows.select(F.lit("jobs_created").alias("metric_name"), "source_id", (F.col("n") * times).alias("target_value"), F.lit(name).alias("range_key")), path, "range_key")
    return spark.read.schema("metric_name string, source_id long, target_value long, range_key string").parquet(path)


def source_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two runs over the orders: the videos they name are created once, and the second run finds nothing new."""
    path = work_dir(spark, "sync")
    like = read(spark, sf_dir, "orders").schema
    for _ in range(2):
        sync_source(spark, f"{sf_dir}/orders.parquet*", ["o_custkey", "o_orderdate"], like, "o_custkey", "o_orderdate", path)
    return sync_log(spark, path, "timestamp_ntz").agg(F.sum("discovered").alias("discovered"), F.sum("created").alias("created"), F.sum("skipped").alias("skipped"), F.max("cursor").alias("cursor"))


QUERIES = {"profiles_upserted": profiles_upserted, "signup_grants": signup_grants, "targets_replaced": targets_replaced, "source_sync": source_sync}
ORACLES = {name: Report(sql).oracle() for name, sql in {
    "profiles_upserted": """
WITH a AS (SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.name, o.name) AS name, coalesce(n.tier, o.tier) AS tier, CASE WHEN n.user_id IS NULL THEN 0 ELSE 1 END AS version
  FROM {usr} o FULL JOIN (SELECT user_id + 10 AS user_id, 'new ' || name AS name, tier FROM {usr} WHERE user_id % 3 = 0) n ON o.user_id = n.user_id)
SELECT a.user_id, coalesce(CASE WHEN u.user_id % 10 = 0 THEN 'late ' || u.name END, a.name) AS name, CASE WHEN u.user_id IS NULL THEN a.tier ELSE 'MOVED' END AS tier, CASE WHEN u.user_id IS NULL THEN a.version ELSE 2 END AS version
FROM a LEFT JOIN {usr} u ON u.user_id = a.user_id AND u.user_id % 5 = 0""",
    "signup_grants": "SELECT 'signup_bonus:' || user_id AS grant_key, user_id, 100 AS amount, 'grant' AS kind, CAST(MIN(created_at) >= ts'2024-01-16' AS BIGINT) AS batch FROM {qlog} WHERE event_type = 'signup' GROUP BY user_id",
    "targets_replaced": "SELECT 'jobs_created' AS metric_name, source_id, COUNT(*) * 4 AS target_value, '30d' AS range_key FROM {job} GROUP BY source_id UNION ALL SELECT 'jobs_created', source_id, COUNT(*) * 2, '7d' FROM {job} WHERE source_id % 2 = 0 GROUP BY source_id",
    "source_sync": "SELECT COUNT(*) AS discovered, COUNT(DISTINCT video) AS created, COUNT(*) - COUNT(DISTINCT video) AS skipped, MAX(created_at) AS cursor FROM {job}",
}.items()}
