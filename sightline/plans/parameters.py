"""Reports that take parameters. An absent or blank parameter is no condition; what is out of range is
either brought into it (paging of logs) or refused (search requests)."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.scalars import capitalised, compact_number, relative_time
from sightline.operators import vector_index
from sightline.operators.retrieval import query_units
from sightline.plans.report import JOBS_AS_OF, Report
from sightline.sources.logical import query_log, timed_jobs, transcripts, units


def present(params) -> dict:
    """The parameters that were given; blanks are none."""
    found = {f.name: getattr(params, f.name) for f in fields(params)}
    return {k: v.strip() if isinstance(v, str) else v for k, v in found.items() if v is not None and (not isinstance(v, str) or v.strip())}


def filtered(rows: DataFrame, given: dict, conditions: dict[str, Callable[[object], Column]]) -> DataFrame:
    for name, condition in conditions.items():
        if name in given:
            rows = rows.filter(condition(given[name]))
    return rows


@dataclass(frozen=True)
class LogParams:
    """``request_id`` finds one request whatever else is given. ``surface`` all is no condition, so it
    includes requests without a surface; ``start`` is inside and ``end`` outside of the range."""

    request_id: int | None = None
    user_id: int | None = None
    query: str | None = None
    surface: str | None = None
    start: datetime.datetime | None = None
    end: datetime.datetime | None = None
    limit: int | None = 50
    offset: int | None = 0

    def page(self) -> tuple[int, int]:
        """What is not given falls back to the first 50."""
        return max(1, min(100, 50 if self.limit is None else self.limit)), max(0, self.offset or 0)


def query_logs(spark: SparkSession, sf_dir: str, params: LogParams = LogParams()) -> DataFrame:
    """A page of the query log, the latest first. Conditions on the time reach the scan."""
    rows, given = query_log(spark, sf_dir), present(params)
    if "request_id" in given:
        rows = rows.filter(F.col("request_id") == given["request_id"])
    else:
        if given.get("surface") == "all":
            del given["surface"]
        rows = filtered(rows, given, {
            "user_id": lambda x: F.col("user_id") == x,
            "query": lambda x: F.contains(F.lower("query_text"), F.lit(x.lower())),
            "surface": lambda x: F.col("surface") == x,
            "start": lambda x: F.col("created_at") >= F.lit(x).cast("timestamp_ntz"),
            "end": lambda x: F.col("created_at") < F.lit(x).cast("timestamp_ntz"),
        })
    limit, offset = params.page()
    return rows.select("request_id", "user_id", "query_text", "surface", "result_count", "created_at").orderBy(F.desc("created_at"), "request_id").offset(offset).limit(limit)


@dataclass(frozen=True)
class SearchParams:
    """Durations are inclusive, ``published_after`` is not. Refused: a query of white space or more than
    400 characters, results outside of 1 to 50, and a least duration above the greatest."""

    query: str | None = None
    speaker: str | None = None
    source: str | None = None
    published_after: datetime.date | None = None
    min_duration: int | None = None
    max_duration: int | None = None
    max_results: int = 10

    def __post_init__(self):
        if self.query is not None and (not self.query.strip() or len(self.query) > 400):
            raise ValueError("query must have 1 to 400 characters, not all of them white space")
        if isinstance(self.max_results, bool) or not 1 <= self.max_results <= 50:
            raise ValueError("max_results must be 1 to 50")
        if self.min_duration is not None and self.max_duration is not None and self.min_duration > self.max_duration:
            raise ValueError("min_duration must not exceed max_duration")


def search_arguments(arguments: dict) -> SearchParams:
    """The parameters of a tool call, whose filters stand beside the query; unknown arguments are refused."""
    names = {f.name for f in fields(SearchParams)}
    unknown = arguments.keys() - names - {"ranking_mode", "include_answer"}
    if unknown:
        raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")
    if arguments.get("ranking_mode", "embedding") not in ("embedding", "rerank"):
        raise ValueError("ranking_mode must be embedding or rerank")
    given = {k: v for k, v in arguments.items() if k in names and v is not None}
    if isinstance(given.get("published_after"), str):
        given["published_after"] = datetime.date.fromisoformat(given["published_after"])
    return SearchParams(**given)


def search_units(spark: SparkSession, sf_dir: str, params: SearchParams = SearchParams()) -> DataFrame:
    """The best units for each query unit among those whose transcript fits the filters."""
    script = transcripts(spark, sf_dir).withColumn("published_at", F.expr("date_add(DATE'2024-01-01', CAST(doc_id % 365 AS INT))"))
    given = present(params)
    if given.get("min_duration") == 0:
        del given["min_duration"]  # no least duration is no filter
    fitting = filtered(script, given, {
        "speaker": lambda x: F.col("speaker") == x,
        "source": lambda x: F.col("lang") == x,
        "published_after": lambda x: F.col("published_at") > F.lit(x),
        "min_duration": lambda x: F.col("n_chars") >= x,
        "max_duration": lambda x: F.col("n_chars") <= x,
    })
    rows = units(spark, sf_dir)
    if given.keys() & {"speaker", "source", "published_after", "min_duration", "max_duration"}:
        rows = rows.join(fitting.select(F.col("doc_id").alias("unit_id")), "unit_id", "left_semi")
    found = vector_index.nearest(rows, query_units(spark, sf_dir), vector_index.SearchParams(k=params.max_results))
    return found.select("query_id", "unit_id", "video", "score")


def docs_search(spark: SparkSession, sf_dir: str, query: str = "", first: int = 8) -> DataFrame:
    """Entries whose title, text kind or category contains the query, whatever its case; without one the first entries."""
    title = F.substring_index("text", "\n", 1)
    entries = transcripts(spark, sf_dir).select("doc_id", title.alias("title"), "speaker", "lang")
    if query.strip():
        return entries.filter(F.contains(F.lower(F.concat_ws(" ", "title", "speaker", "lang")), F.lit(query.strip().lower())))
    return entries.orderBy("doc_id").limit(first)


def job_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as a console shows them: status, size and age in words, and each job's share of its source's peak."""
    now = F.lit(JOBS_AS_OF).cast("timestamp_ntz")
    peak = F.greatest(F.lit(1.0), F.max("processing_ms").over(Window.partitionBy("source_id")))
    return timed_jobs(spark, sf_dir).select(
        "job_id", capitalised(F.col("status")).alias("status_text"), compact_number(F.col("processing_ms")).alias("size_text"),
        relative_time(F.col("created_at"), now).alias("age_text"), F.round(F.col("processing_ms") / peak, 6).alias("peak_ratio"),
        F.coalesce((F.col("status") == "running") & (F.col("started_at") < now - F.expr("INTERVAL 8 MINUTES")), F.lit(False)).alias("long_running"),
    )


ONE_USER = LogParams(user_id=3, query=" Query 1", surface="all", start=datetime.datetime(2024, 1, 5), end=datetime.datetime(2024, 1, 25), limit=500, offset=-4)
SHORT = SearchParams(source="en", published_after=datetime.date(2024, 2, 1), min_duration=100, max_duration=4000, max_results=5)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "query_logs": query_logs,
    "query_logs_of_user": lambda spark, sf_dir: query_logs(spark, sf_dir, ONE_USER),
    "query_log_of_id": lambda spark, sf_dir: query_logs(spark, sf_dir, LogParams(request_id=17, user_id=-1)),
    "search_units": search_units,
    "search_units_filtered": lambda spark, sf_dir: search_units(spark, sf_dir, SHORT),
    "job_display": job_display,
    "docs_search": docs_search,
    "docs_search_text": lambda spark, sf_dir: docs_search(spark, sf_dir, " The "),
}
_LOG = "SELECT request_id, user_id, query_text, surface, result_count, created_at FROM {qlog}"
_DOT = "list_sum(list_transform(range(1, len(u.embedding) + 1), lambda i: u.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))"
_TOP = f"""SELECT query_id, unit_id, video, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS place FROM (
    SELECT q.unit_id AS query_id, u.unit_id, u.video, round(greatest(least({_DOT}, 1), 0), 5) AS score FROM {{unit}} u JOIN {{unit}} q ON q.unit_id % 50 = 0 AND u.unit_id <> q.unit_id WHERE [where])) WHERE place <= [k]"""
_FITTING = "u.unit_id IN (SELECT doc_id FROM {script} WHERE lang = 'en' AND DATE '2024-01-01' + CAST(doc_id % 365 AS INT) > DATE '2024-02-01' AND n_chars BETWEEN 100 AND 4000)"
_DISPLAY = f"""
SELECT job_id, upper(left(status, 1)) || substring(status, 2) AS status_text,
  CASE WHEN processing_ms >= 1e6 THEN printf('%.1f', floor(processing_ms / 1e5 + 0.5) / 10) || 'M' WHEN processing_ms >= 1e3 THEN printf('%.1f', floor(processing_ms / 100 + 0.5) / 10) || 'K' ELSE CAST(CAST(floor(processing_ms + 0.5) AS BIGINT) AS VARCHAR) END AS size_text,
  CASE WHEN age < 60 THEN 'Just now' WHEN age < 3600 THEN (age // 60) || 'm ago' WHEN age < 86400 THEN (age // 3600) || 'h ago' WHEN age < 604800 THEN (age // 86400) || 'd ago' ELSE strftime(created_at, '%b %-d') END AS age_text,
  round(processing_ms / greatest(1, max(processing_ms) OVER (PARTITION BY source_id)), 6) AS peak_ratio,
  coalesce(status = 'running' AND started_at < TIMESTAMP '{JOBS_AS_OF}' - INTERVAL 8 MINUTE, FALSE) AS long_running
FROM (SELECT *, date_diff('second', created_at, TIMESTAMP '{JOBS_AS_OF}') AS age FROM {{tjob}})"""
ORACLES = {name: Report(sql).oracle() for name, sql in {
    "query_logs": f"{_LOG} ORDER BY created_at DESC, request_id LIMIT 50",
    "query_logs_of_user": f"{_LOG} WHERE user_id = 3 AND lower(query_text) LIKE '%query 1%' AND created_at >= ts'2024-01-05' AND created_at < ts'2024-01-25' ORDER BY created_at DESC, request_id LIMIT 100",
    "query_log_of_id": f"{_LOG} WHERE request_id = 17",
    "search_units": _TOP.replace("[where]", "TRUE").replace("[k]", "10"),
    "search_units_filtered": _TOP.replace("[where]", _FITTING).replace("[k]", "5"),
    "job_display": _DISPLAY,
    "docs_search": "SELECT doc_id, split_part(text, chr(10), 1) AS title, speaker, lang FROM {script} ORDER BY doc_id LIMIT 8",
    "docs_search_text": "SELECT doc_id, split_part(text, chr(10), 1) AS title, speaker, lang FROM {script} WHERE contains(lower(concat_ws(' ', split_part(text, chr(10), 1), speaker, lang)), 'the')",
}.items()}
