"""The logical tables of the reports, derived from the stored ones, and the same as DuckDB SQL.

Clicks and detail views carry ids of their own, so each is credited to the latest earlier
impression with the same user and creator, and an impression counts once however often it is hit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.sources.tables import read


def _told(event_id: Column) -> list[Column]:
    """What the id of an event says of its request: the surface, and whether an answer was asked for."""
    surface = F.element_at(F.array(*map(F.lit, ("api", "playground", "mcp"))), (event_id % 4 + 1).cast("int"))
    return [F.when(event_id % 4 < 3, surface).alias("surface"), (event_id % 5 == 0).alias("include_answer")]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), *_told(F.col("event_id")))


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, and whether a later click or purchase is credited to them. Events meet in days of a user and creator,
    whose last views are carried over, so a user with very many events is no single task."""
    events = _events(spark, sf_dir).filter(F.col("event_type").isin("view", "click", "purchase")).select("event_id", "ts", "user_id", "event_type", "k", (F.col("k") % 10).alias("creator"), F.col("ts").cast("date").alias("day"))
    is_view, group = F.col("event_type") == "view", ["user_id", "creator", "day"]
    in_day = Window.partitionBy(*group).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("user_id", "creator").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    last = events.groupBy(*group).agg(F.max(F.when(is_view, F.struct("ts", "event_id")))["event_id"].alias("view"))
    carried = last.select(*group, F.last("view", ignorenulls=True).over(before).alias("carried"))
    seen = events.withColumn("view", F.last(F.when(is_view, F.col("event_id")), ignorenulls=True).over(in_day)).join(carried, group, "left")
    seen = seen.withColumn("view", F.coalesce("view", "carried")).filter("view IS NOT NULL AND (event_type = 'view' OR (user_id IS NOT NULL AND creator IS NOT NULL))")
    hit = lambda kind: F.max((F.col("event_type") == kind).cast("long"))
    # all events of a view are of its user; what else is told of it are fixed-width maxima of its own row
    of_view = seen.groupBy("view").agg(F.max(F.when(is_view, F.col("ts"))).alias("ts"), F.max("user_id").alias("user_id"), F.max(F.when(is_view, F.col("k"))).alias("video"), hit("click").alias("clicked"), hit("purchase").alias("viewed"))
    return of_view.select(
        F.col("view").alias("request_id"), "ts", "user_id", "video", (F.col("video") % 10).alias("creator"), (F.col("view") % 10).alias("rank"),
        *_told(F.col("view")), F.concat(F.lit("query "), F.col("video").cast("string")).alias("query_text"), "clicked", "viewed",
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"), "user_id", F.concat(F.lit("query "), F.col("k").cast("string")).alias("query_text"), "surface", "include_answer",
        F.when(F.col("event_type") == "error", 0).otherwise(F.col("k") % 5 + 1).cast("long").alias("result_count"),
        F.col("value").alias("latency_ms"), (F.lit(1) + F.col("include_answer").cast("int")).cast("long").alias("credits"), F.col("ts").alias("created_at"), "event_type",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    status = F.when((s == "F") & (p == "5-LOW"), "failed").when(s == "F", "completed").when((s == "O") & (p == "1-URGENT"), "retrying").when(s == "O", "pending").otherwise("running")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("video"), F.floor(F.col("o_custkey") / 15).alias("source_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("processing_ms"))


def timed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their start, end and last change. Pending ones have not started; the change may stand before the start."""
    after = lambda c, **x: c + F.make_dt_interval(**x)
    started = F.when(F.col("status") != "pending", after(F.col("created_at"), mins=(F.col("job_id") % 50).cast("int")))
    completed = F.when(F.col("status").isin("completed", "failed"), after(started, secs=F.floor("processing_ms").cast("decimal(18,6)") / 10))
    return jobs(spark, sf_dir).withColumns({"started_at": started, "completed_at": completed, "updated_at": after(F.col("created_at"), hours=(F.col("job_id") % 7).cast("int"))})


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_partkey", "l_quantity").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("step"), F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "completed").otherwise("running").alias("status"),
        F.col("l_shipdate").alias("finished_at"), F.col("l_partkey").alias("worker"), F.col("l_quantity").alias("frames"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tier"), F.col("c_nationkey").cast("long").alias("region"), F.col("c_acctbal").alias("balance"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.floor("s_acctbal").cast("long").alias("subscribers"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("result_id"), (F.col("doc_id") % 50).alias("video"), (F.col("doc_id") % 97).alias("user_id"), F.when(F.col("quality") == 1, 1).otherwise(-1).cast("long").alias("rating"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("label").cast("long").alias("video"), F.element_at(F.array(*map(F.lit, ("summary", "speech", "visual"))), (F.col("vec_id") % 3 + 1).cast("int")).alias("unit_type"), "embedding")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", "page_id", "url")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("speaker"), "n_chars", "text")


LOGICAL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "impr": impressions, "qlog": query_log, "job": jobs, "step": steps, "usr": users, "src": sources,
    "tjob": timed_jobs, "fb": feedback, "unit": units, "thread": threads, "url": urls, "script": transcripts,
}

#: name -> (logical tables it stands on, DuckDB SQL)
DUCKDB: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  CASE event_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'playground' WHEN 2 THEN 'mcp' END AS surface, event_id % 5 = 0 AS include_answer FROM events"""),
    "impr": (("ev",), """SELECT v.event_id AS request_id, v.ts, v.user_id, v.k AS video, v.k % 10 AS creator, v.event_id % 10 AS rank, v.surface, v.include_answer,
  'query ' || CAST(v.k AS VARCHAR) AS query_text, CAST(c.view_id IS NOT NULL AS BIGINT) AS clicked, CAST(p.view_id IS NOT NULL AS BIGINT) AS viewed
FROM ev v
LEFT JOIN (SELECT DISTINCT i.event_id AS view_id FROM (SELECT * FROM ev WHERE event_type = 'click') c
  ASOF JOIN (SELECT * FROM ev WHERE event_type = 'view') i ON c.user_id = i.user_id AND c.k % 10 = i.k % 10 AND c.ts >= i.ts) c ON c.view_id = v.event_id
LEFT JOIN (SELECT DISTINCT i.event_id AS view_id FROM (SELECT * FROM ev WHERE event_type = 'purchase') c
  ASOF JOIN (SELECT * FROM ev WHERE event_type = 'view') i ON c.user_id = i.user_id AND c.k % 10 = i.k % 10 AND c.ts >= i.ts) p ON p.view_id = v.event_id
WHERE v.event_type = 'view'"""),
    "qlog": (("ev",), """SELECT event_id AS request_id, user_id, 'query ' || CAST(k AS VARCHAR) AS query_text, surface, include_answer,
  CASE WHEN event_type = 'error' THEN 0 ELSE k % 5 + 1 END AS result_count, value AS latency_ms, CAST(1 + CAST(include_answer AS INT) AS BIGINT) AS credits, ts AS created_at, event_type FROM ev"""),
    "job": ((), """SELECT o_orderkey AS job_id, o_custkey AS video, o_custkey // 15 AS source_id,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed'
       WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'retrying' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'running' END AS status,
  o_orderdate AS created_at, o_totalprice AS processing_ms FROM orders"""),
    "tjob": (("job",), """SELECT *, CASE WHEN status <> 'pending' THEN created_at + INTERVAL 1 MINUTE * (job_id % 50) END AS started_at,
  CASE WHEN status IN ('completed', 'failed') THEN created_at + INTERVAL 1 MINUTE * (job_id % 50) + INTERVAL 1 MILLISECOND * CAST(floor(processing_ms) * 100 AS BIGINT) END AS completed_at, created_at + INTERVAL 1 HOUR * (job_id % 7) AS updated_at FROM job"""),
    "step": ((), """SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS step, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'completed' ELSE 'running' END AS status,
  l_shipdate AS finished_at, l_partkey AS worker, l_quantity AS frames FROM lineitem"""),
    "usr": ((), "SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS tier, CAST(c_nationkey AS BIGINT) AS region, c_acctbal AS balance FROM customer"),
    "src": ((), "SELECT s_suppkey AS source_id, s_name AS name, CAST(floor(s_acctbal) AS BIGINT) AS subscribers FROM supplier"),
    "fb": ((), "SELECT doc_id AS result_id, doc_id % 50 AS video, doc_id % 97 AS user_id, CAST(CASE WHEN quality = 1 THEN 1 ELSE -1 END AS BIGINT) AS rating FROM labels"),
    "unit": ((), "SELECT vec_id AS unit_id, CAST(label AS BIGINT) AS video, CASE vec_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'speech' ELSE 'visual' END AS unit_type, embedding FROM embeddings"),
    "thread": ((), "SELECT conv_id, turn, role, text FROM conversations"),
    "url": ((), "SELECT page_id, url FROM pages"),
    "script": ((), "SELECT doc_id, lang, source AS speaker, n_chars, text FROM documents"),
}
