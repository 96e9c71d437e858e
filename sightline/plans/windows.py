"""Reports over windows: today, 7 or 30 days up to a moment, each with the equally long window before it, and
metrics with their targets. Jobs and steps are dated as if they ended when the events do."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.quantiles import exact_quantiles
from sightline.sources.logical import jobs, query_log, steps
from sightline.sources.tables import read

AS_OF = datetime.datetime(2024, 1, 30, 12)
#: From the day that jobs end to the day that events end.
JOB_SHIFT = (datetime.date(2024, 1, 30) - datetime.date(2001, 8, 1)).days
DAYS = {"today": 1, "7d": 7, "30d": 30}
HOURS = {"24h": 24, "3d": 72, "7d": 168, "15d": 360, "30d": 720}


@dataclass(frozen=True)
class ReportWindow:
    """Start inside, end outside."""

    key: str
    current_start: datetime.datetime
    current_end: datetime.datetime

    @property
    def previous_start(self) -> datetime.datetime:
        return self.current_start - (self.current_end - self.current_start)

    @staticmethod
    def of(key: str, as_of: datetime.datetime = AS_OF) -> ReportWindow:
        """Whole UTC days up to ``as_of``, the last of them unfinished."""
        if key not in DAYS:
            raise ValueError(f"range must be one of {', '.join(DAYS)}")
        first = datetime.datetime.combine(as_of.date() - datetime.timedelta(days=DAYS[key] - 1), datetime.time())
        return ReportWindow(key, first, as_of)

    @staticmethod
    def hours(key: str, as_of: datetime.datetime = AS_OF) -> ReportWindow:
        return ReportWindow(key, as_of - datetime.timedelta(hours=HOURS[key]), as_of)

    def current(self, at: str) -> Column:
        return (F.col(at) >= moment(self.current_start)) & (F.col(at) < moment(self.current_end))

    def previous(self, at: str) -> Column:
        return (F.col(at) >= moment(self.previous_start)) & (F.col(at) < moment(self.current_start))


def moment(at: datetime.datetime) -> Column:
    return F.lit(at.isoformat(" ")).cast("timestamp_ntz")


def dated_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).withColumn("created_at", F.col("created_at") + F.expr(f"INTERVAL {JOB_SHIFT} DAYS"))


def dated_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).withColumn("finished_at", F.col("finished_at") + F.expr(f"INTERVAL {JOB_SHIFT} DAYS"))


@dataclass(frozen=True)
class Facts:
    """A table, its time, and the metrics that are sums over it: each gets the condition of a window."""

    rows: Callable[[SparkSession, str], DataFrame]
    at: str
    metrics: dict[str, Callable[[Column], Column]]


def _count(also: str = "TRUE") -> Callable[[Column], Column]:
    return lambda inside: F.count_if(inside & F.expr(also))


def _share(part: str, of: str) -> Callable[[Column], Column]:
    return lambda inside: F.try_divide(F.count_if(inside & F.expr(part)), F.count_if(inside & F.expr(of)))


FACTS = (
    Facts(query_log, "created_at", {
        "new_users": _count("event_type = 'signup'"), "active_users": lambda inside: F.count_distinct(F.when(inside, F.col("user_id"))), "requests": _count(),
        "credits_used": lambda inside: F.coalesce(F.sum(F.when(inside, F.col("credits"))), F.lit(0)), "zero_result_queries": _count("result_count = 0"), "answer_usage_rate": _share("include_answer", "TRUE"),
    }),
    Facts(dated_jobs, "created_at", {
        "jobs_created": _count(), "jobs_completed": _count("status = 'completed'"), "jobs_failed": _count("status = 'failed'"), "pending_backlog": _count("status IN ('pending', 'retrying')"),
        "completion_rate": _share("status = 'completed'", "status IN ('completed', 'failed')"), "failure_rate": _share("status = 'failed'", "status IN ('completed', 'failed')"),
        "average_processing_ms": lambda inside: F.avg(F.when(inside & (F.col("status") == "completed"), F.col("processing_ms"))),
        "videos_added": lambda inside: F.count_distinct(F.when(inside & (F.col("status") == "completed"), F.col("video"))),
    }),
    Facts(dated_steps, "finished_at", {"segments_added": _count("status = 'completed'")}),
)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric_name, scope_type, scope_key, range_key, comparison_mode, target_value: one for each name, scope and
    range, the one that was written last."""
    names = [n for f in FACTS for n in f.metrics]
    k = F.col("n_nationkey")
    given = read(spark, sf_dir, "nation").select(
        F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int")).alias("metric_name"), F.lit("global").alias("scope_type"), F.lit("global").alias("scope_key"),
        F.element_at(F.array(*map(F.lit, DAYS)), (k % 3 + 1).cast("int")).alias("range_key"), F.when(k % 2 == 0, "at_least").otherwise("at_most").alias("comparison_mode"), (k * 20 + 1).cast("double").alias("target_value"), k.cast("long").alias("version"),
    )
    s = F.col("s_suppkey")
    of_sources = read(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select(
        F.lit("jobs_created").alias("metric_name"), F.lit("source").alias("scope_type"), s.cast("string").alias("scope_key"), F.lit("30d").alias("range_key"), F.lit("at_least").alias("comparison_mode"), (s % 5 + 1).cast("double").alias("target_value"), F.lit(0).cast("long").alias("version"),
    )
    scope = ["metric_name", "scope_type", "scope_key", "range_key"]
    last = given.unionByName(of_sources).groupBy(*scope).agg(F.max(F.struct("version", "comparison_mode", "target_value")).alias("last"))
    return last.select(*scope, "last.comparison_mode", "last.target_value")


def measured(spark: SparkSession, sf_dir: str, w: ReportWindow) -> DataFrame:
    """metric_name, current, previous of all metrics: one filtered scan of each table."""
    out = None
    for f in FACTS:
        rows = f.rows(spark, sf_dir).filter((F.col(f.at) >= moment(w.previous_start)) & (F.col(f.at) < moment(w.current_end)))
        sums = rows.agg(*(make(inside).cast("double").alias(f"{when}_{name}") for name, make in f.metrics.items() for when, inside in (("c", w.current(f.at)), ("p", w.previous(f.at)))))
        long = sums.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric_name"), F.col(f"c_{n}").alias("current"), F.col(f"p_{n}").alias("previous")) for n in f.metrics))))
        out = long if out is None else out.unionByName(long)
    return out


def compared(rows: DataFrame) -> DataFrame:
    """``rows`` (current, previous, target_value) with what a console shows of them."""
    c, p, t = F.col("current"), F.col("previous"), F.col("target_value")
    return rows.withColumns({
        "delta": F.round(c - p, 6), "delta_ratio": F.round(F.try_divide(c - p, p), 6), "target_gap": F.round(c - t, 6), "attainment_ratio": F.round(F.try_divide(c, t), 6),
        "tone": F.when(t.isNull() | c.isNull(), "neutral").when(F.when(F.col("comparison_mode") == "at_most", c <= t).otherwise(c >= t), "good").otherwise("bad"),
        "current": F.round(c, 6), "previous": F.round(p, 6),
    })


def admin_metrics(spark: SparkSession, sf_dir: str, window: ReportWindow) -> DataFrame:
    wanted = targets(spark, sf_dir).filter((F.col("range_key") == window.key) & (F.col("scope_type") == "global")).select("metric_name", "comparison_mode", "target_value")
    return compared(measured(spark, sf_dir, window).join(wanted, "metric_name", "left"))


def metric_targets(spark: SparkSession, sf_dir: str, as_of: datetime.datetime = AS_OF) -> DataFrame:
    """Every target with the actual value of its name, scope and range."""
    actual = None
    for key in DAYS:
        of = measured(spark, sf_dir, ReportWindow.of(key, as_of)).select("metric_name", F.lit("global").alias("scope_type"), F.lit("global").alias("scope_key"), F.lit(key).alias("range_key"), F.col("current").alias("actual_value"))
        actual = of if actual is None else actual.unionByName(of)
    month = ReportWindow.of("30d", as_of)
    sources = dated_jobs(spark, sf_dir).filter(month.current("created_at")).groupBy("source_id").agg(F.count("*").cast("double").alias("actual_value"))
    actual = actual.unionByName(sources.select(F.lit("jobs_created").alias("metric_name"), F.lit("source").alias("scope_type"), F.col("source_id").cast("string").alias("scope_key"), F.lit("30d").alias("range_key"), "actual_value"))
    a, t = F.col("actual_value"), F.col("target_value")
    rows = targets(spark, sf_dir).join(actual, ["metric_name", "scope_type", "scope_key", "range_key"], "left")
    return rows.withColumns({"actual_value": F.round(a, 6), "attainment_ratio": F.round(F.try_divide(a, t), 6), "target_gap": F.round(a - t, 6)})


def calendar(spark: SparkSession, first: datetime.date, last: datetime.date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 DAY"))).alias("day"))


def daily_series(spark: SparkSession, sf_dir: str, window: ReportWindow) -> DataFrame:
    """Nine counters of each day of the window; days without rows have 0, and no latency."""
    day = lambda at: F.col(at).cast("date").alias("day")
    log = query_log(spark, sf_dir).filter(window.current("created_at")).withColumn("day", day("created_at"))
    of_jobs = dated_jobs(spark, sf_dir).filter(window.current("created_at")).groupBy(day("created_at")).agg(
        F.count("*").alias("assets_added"), F.count_distinct(F.when(F.col("status") == "completed", F.col("video"))).alias("videos_added"),
        F.count_if(F.col("status") == "completed").alias("jobs_completed"), F.count_if(F.col("status") == "failed").alias("jobs_failed"),
    )
    of_steps = dated_steps(spark, sf_dir).filter(window.current("finished_at") & (F.col("status") == "completed")).groupBy(day("finished_at")).agg(F.count("*").alias("segments_added"))
    of_log = log.groupBy("day").agg(F.count("*").alias("requests"), F.sum("credits").alias("credits_used"), F.count_if(F.col("result_count") == 0).alias("zero_result_queries"))
    late = exact_quantiles(log, "latency_ms", {"latency_p95_ms": 0.95}, ("day",))
    out = calendar(spark, window.current_start.date(), window.current_end.date())
    for part in (of_log, of_jobs, of_steps, late):
        out = out.join(part, "day", "left")
    counters = ("requests", "credits_used", "zero_result_queries", "assets_added", "videos_added", "segments_added", "jobs_completed", "jobs_failed")
    return out.select("day", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counters), F.round("latency_p95_ms", 4).alias("latency_p95_ms"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_quantiles(query_log(spark, sf_dir), "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select(*(F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")))


def daily_latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of the month; null where there was no request."""
    rows = query_log(spark, sf_dir).select(F.col("created_at").cast("date").alias("day"), "latency_ms")
    found = exact_quantiles(rows, "latency_ms", {"latency_p95_ms": 0.95}, ("day",))
    return calendar(spark, datetime.date(2024, 1, 1), datetime.date(2024, 1, 31)).join(found, "day", "left").select("day", F.round("latency_p95_ms", 4).alias("latency_p95_ms"))


def source_analytics(spark: SparkSession, sf_dir: str, as_of: datetime.datetime = AS_OF) -> DataFrame:
    """Jobs of each source over five ranges, with the range before: one pass, a row for each source and range."""
    rows = dated_jobs(spark, sf_dir)
    sums = []
    for key in HOURS:
        w = ReportWindow.hours(key, as_of)
        now, before = w.current("created_at"), w.previous("created_at")
        is_ = lambda *s: F.col("status").isin(*s)
        cells = {"jobs_created": now, "jobs_completed": now & is_("completed"), "jobs_failed": now & is_("failed"), "running": now & is_("running"), "backlog": now & is_("pending", "retrying"), "prev_jobs_created": before, "prev_jobs_completed": before & is_("completed"), "prev_jobs_failed": before & is_("failed")}
        sums.append(F.struct(F.lit(key).alias("range_key"), *(F.count_if(c).alias(n) for n, c in cells.items())))
    return rows.groupBy("source_id").agg(F.array(*sums).alias("r")).select("source_id", F.inline("r"))


def source_growth(spark: SparkSession, sf_dir: str, window: ReportWindow) -> DataFrame:
    """What each source added in the window and before: videos of completed jobs, and their completed steps."""
    done = dated_jobs(spark, sf_dir).filter("status = 'completed'").select("job_id", "source_id", "video", "created_at")
    now, before = window.current("created_at"), window.previous("created_at")
    near = done.filter((F.col("created_at") >= moment(window.previous_start)) & (F.col("created_at") < moment(window.current_end)))
    videos = near.groupBy("source_id").agg(F.count_distinct(F.when(now, F.col("video"))).alias("videos_added"), F.count_distinct(F.when(before, F.col("video"))).alias("previous_videos_added"))
    parts = near.join(steps(spark, sf_dir).filter("status = 'completed'").select("job_id"), "job_id").groupBy("source_id").agg(F.count_if(now).alias("segments_added"))
    return videos.join(parts, "source_id", "left").select("source_id", "videos_added", "previous_videos_added", F.coalesce("segments_added", F.lit(0)).alias("segments_added"))


def worker_nodes(spark: SparkSession, sf_dir: str, as_of: datetime.datetime = AS_OF) -> DataFrame:
    """Each worker over the last 24 hours: ended steps, their mean frames, what runs on its slots, and whether it is alive."""
    w = ReportWindow.hours("24h", as_of)
    now, rows = w.current("finished_at"), dated_steps(spark, sf_dir).filter(F.col("finished_at") < moment(as_of))
    age = F.timestamp_diff("SECOND", F.col("last_heartbeat"), moment(as_of))
    sums = rows.groupBy("worker").agg(
        F.count_if(now & (F.col("status") == "completed")).alias("completed"), F.count_if(now & (F.col("status") == "failed")).alias("failed"),
        F.round(F.avg(F.when(now & (F.col("status") == "completed"), F.col("frames"))), 4).alias("average_frames"), F.count_if(now & (F.col("status") == "running")).alias("active"), F.max("finished_at").alias("last_heartbeat"),
    )
    state = F.when(age <= 60, "online").when(age <= 86_400, "stale").otherwise("offline")
    return sums.select("worker", "completed", "failed", "average_frames", F.least("active", F.col("worker") % 4 + 1).alias("active"), (F.col("worker") % 4 + 1).alias("slots"), "last_heartbeat", state.alias("state"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"admin_metrics_{key}": (lambda spark, sf_dir, key=key: admin_metrics(spark, sf_dir, ReportWindow.of(key))) for key in DAYS},
    "metric_targets": metric_targets,
    "daily_series": lambda spark, sf_dir: daily_series(spark, sf_dir, ReportWindow.of("30d")),
    "latency_percentiles": latency_percentiles,
    "daily_latency_p95": daily_latency_p95,
    "source_analytics": source_analytics,
    "worker_node_24h": worker_nodes,
    "source_growth": lambda spark, sf_dir: source_growth(spark, sf_dir, ReportWindow.of("30d")),
}

_JOBS = f"""job AS (SELECT o_orderkey AS job_id, o_custkey AS video, o_custkey // 15 AS source_id, o_totalprice AS ms, o_orderdate + INTERVAL {JOB_SHIFT} DAY AS created_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'retrying' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'running' END AS status FROM orders)"""
_DONE = f"done AS (SELECT l_shipdate + INTERVAL {JOB_SHIFT} DAY AS at FROM lineitem WHERE l_returnflag = 'A')".replace(" at ", ' "at" ')


def _measured_sql(key: str) -> str:
    w = ReportWindow.of(key)
    parts = []
    for when, start, end in (("current", w.current_start, w.current_end), ("previous", w.previous_start, w.current_start)):
        inside = lambda at: f"{at} >= TIMESTAMP '{start}' AND {at} < TIMESTAMP '{end}'"  # noqa: B023, E731
        of = lambda table, at, *metrics: [f"SELECT '{n}' AS metric_name, CAST({x} AS DOUBLE) AS v FROM {table} WHERE {inside(at)}" for n, x in metrics]
        rows = [
            *of("events", "ts", ("new_users", "count(*) FILTER (WHERE event_type = 'signup')"), ("active_users", "count(DISTINCT user_id)"), ("requests", "count(*)"), ("credits_used", "coalesce(sum(1 + (event_id % 5 = 0)::INT), 0)"), ("zero_result_queries", "count(*) FILTER (WHERE event_type = 'error')"), ("answer_usage_rate", "avg((event_id % 5 = 0)::INT)")),
            *of("job", "created_at", ("jobs_created", "count(*)"), ("jobs_completed", "count(*) FILTER (WHERE status = 'completed')"), ("jobs_failed", "count(*) FILTER (WHERE status = 'failed')"), ("pending_backlog", "count(*) FILTER (WHERE status IN ('pending', 'retrying'))"),
                ("completion_rate", "avg((status = 'completed')::INT) FILTER (WHERE status IN ('completed', 'failed'))"), ("failure_rate", "avg((status = 'failed')::INT) FILTER (WHERE status IN ('completed', 'failed'))"), ("average_processing_ms", "avg(ms) FILTER (WHERE status = 'completed')"), ("videos_added", "count(DISTINCT video) FILTER (WHERE status = 'completed')")),
            *of("done", '"at"', ("segments_added", "count(*)")),
        ]
        parts.append(f"SELECT metric_name, v AS {when} FROM ({' UNION ALL '.join(rows)})")
    return f"SELECT c.metric_name, c.current, p.previous FROM ({parts[0]}) c JOIN ({parts[1]}) p ON c.metric_name = p.metric_name"


_NAMES = [n for f in FACTS for n in f.metrics]
_TARGETS = f"""target AS (
  SELECT metric_name, 'global' AS scope_type, 'global' AS scope_key, range_key, arg_max(mode, k) AS comparison_mode, arg_max(v, k) AS target_value FROM (
    SELECT {_NAMES}[n_nationkey % {len(_NAMES)} + 1] AS metric_name, {list(DAYS)}[n_nationkey % 3 + 1] AS range_key, CASE WHEN n_nationkey % 2 = 0 THEN 'at_least' ELSE 'at_most' END AS mode, (n_nationkey * 20 + 1)::DOUBLE AS v, n_nationkey AS k FROM nation) GROUP BY ALL
  UNION ALL SELECT 'jobs_created', 'source', s_suppkey::VARCHAR, '30d', 'at_least', (s_suppkey % 5 + 1)::DOUBLE FROM supplier WHERE s_suppkey % 4 = 0)"""


def _metrics_sql(key: str) -> str:
    return f"""WITH {_JOBS}, {_DONE}, {_TARGETS}
SELECT m.metric_name, round(current, 6) AS current, round(previous, 6) AS previous, comparison_mode, target_value, round(current - previous, 6) AS delta, round((current - previous) / nullif(previous, 0), 6) AS delta_ratio,
  round(current - target_value, 6) AS target_gap, round(current / nullif(target_value, 0), 6) AS attainment_ratio,
  CASE WHEN target_value IS NULL OR current IS NULL THEN 'neutral' WHEN (comparison_mode = 'at_most' AND current <= target_value) OR (comparison_mode = 'at_least' AND current >= target_value) THEN 'good' ELSE 'bad' END AS tone
FROM ({_measured_sql(key)}) m LEFT JOIN target t ON t.metric_name = m.metric_name AND t.range_key = '{key}' AND t.scope_type = 'global'"""


def _analytics_sql() -> str:
    parts = []
    for key in HOURS:
        w = ReportWindow.hours(key)
        now, before = f"created_at >= TIMESTAMP '{w.current_start}' AND created_at < TIMESTAMP '{w.current_end}'", f"created_at >= TIMESTAMP '{w.previous_start}' AND created_at < TIMESTAMP '{w.current_start}'"
        of = lambda name, window, also="TRUE": f"count(*) FILTER (WHERE {window} AND {also}) AS {name}"
        parts.append(f"SELECT source_id, '{key}' AS range_key, " + ", ".join([of("jobs_created", now), of("jobs_completed", now, "status = 'completed'"), of("jobs_failed", now, "status = 'failed'"), of("running", now, "status = 'running'"), of("backlog", now, "status IN ('pending', 'retrying')"), of("prev_jobs_created", before), of("prev_jobs_completed", before, "status = 'completed'"), of("prev_jobs_failed", before, "status = 'failed'")]) + " FROM job GROUP BY source_id")
    return f"WITH {_JOBS} " + " UNION ALL ".join(parts)


_MONTH = ReportWindow.of("30d")
_IN_MONTH = f">= TIMESTAMP '{_MONTH.current_start}'", f"< TIMESTAMP '{_MONTH.current_end}'"
ORACLES = {
    **{f"admin_metrics_{key}": _metrics_sql(key) for key in DAYS},
    "metric_targets": f"""WITH {_JOBS}, {_DONE}, {_TARGETS}, actual AS (
  {" UNION ALL ".join(f"SELECT metric_name, 'global' AS scope_type, 'global' AS scope_key, '{key}' AS range_key, current AS a FROM ({_measured_sql(key)})" for key in DAYS)}
  UNION ALL SELECT 'jobs_created', 'source', source_id::VARCHAR, '30d', count(*) FROM job WHERE created_at {_IN_MONTH[0]} AND created_at {_IN_MONTH[1]} GROUP BY source_id)
SELECT t.*, round(a, 6) AS actual_value, round(a / nullif(target_value, 0), 6) AS attainment_ratio, round(a - target_value, 6) AS target_gap FROM target t LEFT JOIN actual USING (metric_name, scope_type, scope_key, range_key)""".replace("t.*", "metric_name, scope_type, scope_key, range_key, comparison_mode, target_value"),
    "daily_series": f"""WITH {_JOBS}, {_DONE}, c AS (SELECT unnest(range(TIMESTAMP '{_MONTH.current_start}', TIMESTAMP '{_MONTH.current_end}', INTERVAL 1 DAY))::DATE AS day),
q AS (SELECT ts::DATE AS day, count(*) AS requests, sum(1 + (event_id % 5 = 0)::INT) AS credits_used, count(*) FILTER (WHERE event_type = 'error') AS zeros, quantile_cont(value, 0.95) AS p95 FROM events WHERE ts {_IN_MONTH[0]} AND ts {_IN_MONTH[1]} GROUP BY 1),
j AS (SELECT created_at::DATE AS day, count(*) AS assets, count(DISTINCT video) FILTER (WHERE status = 'completed') AS videos, count(*) FILTER (WHERE status = 'completed') AS ok, count(*) FILTER (WHERE status = 'failed') AS bad FROM job WHERE created_at {_IN_MONTH[0]} AND created_at {_IN_MONTH[1]} GROUP BY 1),
s AS (SELECT "at"::DATE AS day, count(*) AS segments FROM done WHERE "at" {_IN_MONTH[0]} AND "at" {_IN_MONTH[1]} GROUP BY 1)
SELECT c.day, coalesce(requests, 0) AS requests, coalesce(credits_used, 0)::BIGINT AS credits_used, coalesce(zeros, 0) AS zero_result_queries, coalesce(assets, 0) AS assets_added, coalesce(videos, 0) AS videos_added, coalesce(segments, 0) AS segments_added,
  coalesce(ok, 0) AS jobs_completed, coalesce(bad, 0) AS jobs_failed, round(p95, 4) AS latency_p95_ms FROM c LEFT JOIN q USING (day) LEFT JOIN j USING (day) LEFT JOIN s USING (day)""",
    "latency_percentiles": "SELECT round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events",
    "daily_latency_p95": "SELECT c.day, round(quantile_cont(value, 0.95), 4) AS latency_p95_ms FROM (SELECT unnest(range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY))::DATE AS day) c LEFT JOIN events e ON e.ts::DATE = c.day GROUP BY c.day",
    "source_analytics": _analytics_sql(),
    "worker_node_24h": f"""SELECT l_partkey AS worker, count(*) FILTER (WHERE now AND l_returnflag = 'A') AS completed, count(*) FILTER (WHERE now AND l_returnflag = 'R') AS failed, round(avg(l_quantity) FILTER (WHERE now AND l_returnflag = 'A'), 4) AS average_frames,
  least(count(*) FILTER (WHERE now AND l_returnflag = 'N'), l_partkey % 4 + 1) AS active, l_partkey % 4 + 1 AS slots, max(d) AS last_heartbeat, CASE WHEN max(d) >= TIMESTAMP '{AS_OF}' - INTERVAL 1 MINUTE THEN 'online' WHEN max(d) >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN 'stale' ELSE 'offline' END AS state
FROM (SELECT *, l_shipdate + INTERVAL {JOB_SHIFT} DAY AS d, l_shipdate + INTERVAL {JOB_SHIFT} DAY >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AS now FROM lineitem) WHERE d < TIMESTAMP '{AS_OF}' GROUP BY l_partkey""",
    "source_growth": f"""WITH {_JOBS}, near AS (SELECT *, created_at >= TIMESTAMP '{_MONTH.current_start}' AS now FROM job WHERE status = 'completed' AND created_at >= TIMESTAMP '{_MONTH.previous_start}' AND created_at < TIMESTAMP '{_MONTH.current_end}')
SELECT source_id, count(DISTINCT video) FILTER (WHERE now) AS videos_added, count(DISTINCT video) FILTER (WHERE NOT now) AS previous_videos_added,
  CAST(coalesce(sum((SELECT count(*) FROM lineitem WHERE l_orderkey = job_id AND l_returnflag = 'A')) FILTER (WHERE now), 0) AS BIGINT) AS segments_added FROM near GROUP BY source_id""",
}
