"""What a console shows of jobs, accounts, usage and tracking links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import display
from sightline.functions.scalars import date_key
from sightline.functions.texts import base36_id, quoted_list, string_hash
from sightline.operators.intervals import overlapping
from sightline.plans.report import Report
from sightline.sources.logical import query_log, steps, timed_jobs, transcripts, users
from sightline.sources.tables import read


def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = display.duration_ms(F.col("started_at"), F.col("completed_at"), F.col("updated_at"))
    ended = F.col("completed_at").isNotNull() | F.col("status").isin("completed", "failed")
    return timed_jobs(spark, sf_dir).select("job_id", "status", ms.alias("duration_ms"), display.job_duration_text(ms, ended).alias("duration_text"), display.step_duration_text(ms).alias("step_text"), display.live_duration_text(ms).alias("live_text"), display.media_duration_text(F.floor(ms / 1000)).alias("media_text"))


def jobs_by_duration(spark: SparkSession, sf_dir: str, longest: bool = True, limit: int = 50) -> DataFrame:
    """A page of jobs by duration; those that have not started come last in either order."""
    rows = job_durations(spark, sf_dir).select("job_id", "status", "duration_ms")
    by = F.desc_nulls_last("duration_ms") if longest else F.asc_nulls_last("duration_ms")
    return rows.orderBy(by, "job_id").limit(limit)


#: A setting as an administrator writes it.
ADMINS = '["Customer#000000003@example.org", \'customer#000000014@example.org\', , "customer#000000003@EXAMPLE.org", "a,b#c@example.org"] # keep short'


def account_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account with its plan, what billing offers, whether it administers, and its active keys."""
    plan = F.when(F.col("tier") == "BUILDING", "pro").when(F.col("tier") == "MACHINERY", "payg").when(F.col("tier") == "HOUSEHOLD", "enterprise").otherwise("free")
    plans = spark.createDataFrame(list(display.PLANS), "plan string, initial_credits long, free_per_day long, included_per_month long, usd_per_1000 double")
    rows = users(spark, sf_dir).select("user_id", F.concat(F.lower("name"), F.lit("@example.org")).alias("email"), F.when(F.col("user_id") % 97 == 0, " Admin").alias("role"), plan.alias("plan"), F.col("balance"))
    keys = read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count_if(F.col("o_orderstatus") != "F").alias("active_keys"))
    top_up = display.top_up_credits(-F.col("balance"))
    out = rows.join(F.broadcast(plans), "plan").join(keys, "user_id", "left")  # the plans are four rows
    return out.select(
        "user_id", "plan", "initial_credits", "free_per_day", "included_per_month", display.billing_action(F.col("plan"), F.col("user_id") % 2 == 0).alias("billing_action"),
        display.is_admin(F.col("role"), F.col("email"), quoted_list(F.lit(ADMINS))).alias("is_admin"), F.coalesce("active_keys", F.lit(0)).alias("active_keys"), top_up.alias("top_up_credits"), F.round(top_up * display.CREDIT_USD, 2).alias("top_up_usd"),
    )


def newest_keys(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """The newest active keys of each account."""
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").filter("o_orderstatus <> 'F'")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return rows.withColumn("place", place.cast("long")).filter(F.col("place") <= n).select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("key_id"), "place", F.col("o_orderdate").alias("created_at"))


def usage_timeline(spark: SparkSession, sf_dir: str, start: str = "2024-01-01", end: str = "2024-02-10T00:00:00Z", reference: str = "2024-01-28") -> DataFrame:
    """Every day of the period up to the reference day. Of several entries for a day the last one counts, entries
    without a valid date go, and days without an entry have 0."""
    kind = F.col("event_id") % 4
    entries = read(spark, sf_dir, "events", "event_id", "ts").groupBy(F.col("ts").cast("date").alias("d"), kind.alias("number")).agg(F.count("*").alias("requests"), F.sum(F.lit(1) + (F.col("event_id") % 5 == 0).cast("int")).alias("credits"))
    text = F.when(F.col("number") == 3, "n/a").when(F.col("number") == 2, F.date_format("d", "yyyy-MM-dd'T12:00:00Z'")).otherwise(F.date_format("d", "yyyy-MM-dd"))
    last = entries.withColumn("key", date_key(text)).filter("key IS NOT NULL").groupBy("key").agg(F.max(F.struct("number", "requests", "credits")).alias("last"))
    until = display.effective_period_end(F.lit(end), F.lit(reference))
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(until), F.expr("INTERVAL 1 DAY"))).alias("day"))
    short, full = display.day_labels(F.col("day"))
    out = days.join(last, F.date_format("day", "yyyy-MM-dd") == F.col("key"), "left")
    return out.select("day", short.alias("short_label"), full.alias("full_label"), F.coalesce("last.requests", F.lit(0)).alias("requests"), F.coalesce("last.credits", F.lit(0)).alias("credits"))


def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir)
    start, end = F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") / 8), F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") / 4)
    return t.select("doc_id", display.time_range_label(start, end).alias("label"), display.step_label(F.concat(F.col("lang"), F.lit("Step")), {"enStep": "English"}).alias("step"))


def tracked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking paths of requests, built from their parts and read back."""
    log = query_log(spark, sf_dir)
    k, request = F.col("request_id") % 6, F.concat(F.lit("r"), F.col("request_id").cast("string"))
    rank, none = (F.col("request_id") % 10).cast("string"), F.array().cast("array<string>")
    parts = F.when(k == 0, none).when(k == 1, F.array(F.lit("detail"))).when(k == 2, F.array(F.lit("other"))).when(k == 3, F.array(request, rank)).when(k == 4, F.array(request, rank, F.lit("go"))).otherwise(F.array(request, rank, F.lit("x")))
    built = log.select(F.col("request_id").alias("event_id"), F.concat(F.lit("/v/s"), (F.col("request_id") % 100).cast("string"), display.tracked_suffix(parts)).alias("path"))
    return built.select("event_id", "path", *(c.alias(n) for n, c in display.tracked_event(F.col("path")).items()))


def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic ids of searches: a 32-bit hash of mode and query in base 36."""
    text = F.concat(F.coalesce("surface", F.lit("search")), F.lit(":"), F.col("query_text"))
    return query_log(spark, sf_dir).select("request_id", string_hash(text).alias("seed"), base36_id(string_hash(text)).alias("short_id"))


def transcript_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hash of whole transcripts, of any script."""
    return transcripts(spark, sf_dir).select("doc_id", string_hash(F.col("text")).alias("seed"))


def account_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that quote their values in several ways."""
    name, tier = F.translate("name", "#", "-"), F.lower("tier")
    text = F.concat(F.lit('["'), name, F.lit(', x", '), tier, F.lit(", '"), tier, F.lit("', "), name, F.lit(", ~, '#"), tier, F.lit("'] # "), name)
    return users(spark, sf_dir).select("user_id", F.array_join(quoted_list(text), "|").alias("items"))


def step_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a job that end within ten days of each other."""
    rows = steps(spark, sf_dir).select("job_id", "step", F.col("finished_at").alias("start"), (F.col("finished_at") + F.expr("INTERVAL 10 DAYS")).alias("end"))
    pairs = overlapping(rows, rows, ["job_id"], 20 * 86_400, "a.step < b.step")
    return pairs.select("a.job_id", F.col("a.step").alias("left_step"), F.col("b.step").alias("right_step"))


QUERIES = {
    "job_durations": job_durations,
    "jobs_by_duration": jobs_by_duration,
    "account_console": account_console,
    "newest_keys": newest_keys,
    "usage_timeline": usage_timeline,
    "segment_labels": segment_labels,
    "tracked_links": tracked_links,
    "request_ids": request_ids,
    "transcript_hashes": transcript_hashes,
    "account_lists": account_lists,
    "step_overlap": step_overlap,
}

_HASH = """(SELECT CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END FROM (SELECT coalesce(list_reduce(list_prepend(0::BIGINT, [unicode(c)::BIGINT for c in string_split([text], '') if c <> '']), lambda a, b: (a * 31 + b) & 4294967295), 0) AS h))"""
_MS = "greatest(0, date_diff('millisecond', started_at, coalesce(completed_at, updated_at)))"
_HMS = "CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END"
ORACLES = {name: Report(sql).oracle() for name, sql in {
    "job_durations": f"""SELECT job_id, status, ms AS duration_ms, CASE WHEN ms IS NULL THEN 'Not started' ELSE {_HMS} || CASE WHEN completed_at IS NOT NULL OR status IN ('completed', 'failed') THEN '' ELSE ' so far' END END AS duration_text,
  CASE WHEN ms IS NULL THEN 'Not recorded' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS step_text,
  CASE WHEN f >= 3600 THEN (f // 3600) || 'h ' || (f % 3600 // 60) || 'm' WHEN f >= 60 THEN (f // 60) || 'm ' || (f % 60) || 's' WHEN ms IS NULL THEN NULL ELSE f || 's' END AS live_text,
  CASE WHEN ms IS NULL THEN '—' WHEN f >= 3600 THEN printf('%d:%02d:%02d', f // 3600, f % 3600 // 60, f % 60) ELSE printf('%d:%02d', f // 60, f % 60) END AS media_text
FROM (SELECT *, greatest(1, CAST(floor(ms / 1000 + 0.5) AS BIGINT)) AS s, ms // 1000 AS f FROM (SELECT *, CASE WHEN started_at IS NOT NULL THEN {_MS} END AS ms FROM {{tjob}}))""",
    "jobs_by_duration": f"SELECT job_id, status, CASE WHEN started_at IS NOT NULL THEN {_MS} END AS duration_ms FROM {{tjob}} ORDER BY duration_ms DESC NULLS LAST, job_id LIMIT 50",
    "account_console": """SELECT user_id, p AS plan, CASE WHEN p <> 'enterprise' THEN 100 END AS initial_credits, CASE WHEN p <> 'enterprise' THEN 10 END AS free_per_day, CASE p WHEN 'pro' THEN 5000 WHEN 'enterprise' THEN NULL ELSE 0 END AS included_per_month,
  CASE WHEN p = 'free' THEN 'checkout' WHEN p <> 'enterprise' AND user_id % 2 = 0 THEN 'portal' END AS billing_action, user_id % 97 = 0 OR lower(name) IN ('customer#000000003', 'customer#000000014') AS is_admin, coalesce(n, 0) AS active_keys, q AS top_up_credits, round(q * 0.008, 2) AS top_up_usd
FROM (SELECT *, CASE tier WHEN 'BUILDING' THEN 'pro' WHEN 'MACHINERY' THEN 'payg' WHEN 'HOUSEHOLD' THEN 'enterprise' ELSE 'free' END AS p, greatest(1000, CAST(floor(-balance / 100 + 0.5) * 100 AS BIGINT)) AS q FROM {usr}) u
LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n FROM orders GROUP BY o_custkey) k ON k.o_custkey = u.user_id""",
    "newest_keys": "SELECT o_custkey AS user_id, o_orderkey AS key_id, place, o_orderdate AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'F') WHERE place <= 3",
    "usage_timeline": """SELECT c.day, month(c.day) || '/' || day(c.day) AS short_label, strftime(c.day, '%b %-d') AS full_label, coalesce(e.n, 0) AS requests, coalesce(e.credits, 0)::BIGINT AS credits
FROM (SELECT unnest(range(DATE '2024-01-01', DATE '2024-01-29', INTERVAL 1 DAY))::DATE AS day) c
LEFT JOIN (SELECT ts::DATE AS d, event_id % 4 AS k, count(*) AS n, sum(1 + (event_id % 5 = 0)::INT) AS credits FROM events WHERE event_id % 4 <> 3 GROUP BY ts::DATE, event_id % 4) e ON e.d = c.day
QUALIFY row_number() OVER (PARTITION BY c.day ORDER BY e.k DESC NULLS LAST) = 1""",
    "segment_labels": """SELECT doc_id, CASE WHEN doc_id % 15 = 0 THEN '—' WHEN doc_id % 3 = 0 THEN printf('%.1fs', floor(n_chars / 4 * 10 + 0.5) / 10) WHEN doc_id % 5 = 0 THEN printf('%.1fs', floor(n_chars / 8 * 10 + 0.5) / 10) ELSE printf('%.1fs-%.1fs', floor(n_chars / 8 * 10 + 0.5) / 10, floor(n_chars / 4 * 10 + 0.5) / 10) END AS label, CASE WHEN lang = 'en' THEN 'English' ELSE lang END AS step FROM {script}""",
    "tracked_links": """SELECT event_id, '/v/s' || (event_id % 100) || tail AS path, CASE WHEN tail IS NOT NULL THEN 's' || (event_id % 100) END AS short_id, CASE WHEN event_id % 6 IN (3, 4) THEN 'r' || event_id END AS request_id, CASE WHEN event_id % 6 IN (3, 4) THEN CAST(event_id % 10 AS INT) END AS rank,
  CASE event_id % 6 WHEN 0 THEN 'redirect' WHEN 1 THEN 'page_view' WHEN 3 THEN 'redirect' WHEN 4 THEN 'outbound_click' END AS kind
FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/detail' WHEN 3 THEN '/r' || event_id || '/' || (event_id % 10) WHEN 4 THEN '/r' || event_id || '/' || (event_id % 10) || '/go' END AS tail FROM events)""",
    "request_ids": f"""SELECT request_id, seed, 'req_' || lower(to_base(seed, 36)) AS short_id FROM (SELECT request_id, {_HASH.replace("[text]", "coalesce(surface, 'search') || ':' || query_text")} AS seed FROM {{qlog}})""",
    "transcript_hashes": f"SELECT doc_id, {_HASH.replace('[text]', 'text')} AS seed FROM {{script}}",
    "account_lists": "SELECT user_id, n || ', x|' || lower(tier) || '|' || n || '|#' || lower(tier) AS items FROM (SELECT *, replace(lower(name), '#', '-') AS n FROM {usr})",
    "step_overlap": "SELECT a.job_id, a.step AS left_step, b.step AS right_step FROM {step} a JOIN {step} b ON a.job_id = b.job_id AND a.step < b.step AND a.finished_at < b.finished_at + INTERVAL 10 DAY AND b.finished_at < a.finished_at + INTERVAL 10 DAY",
}.items()}
