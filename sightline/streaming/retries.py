"""The retry queue of jobs: attempts end as completed, failed or stopped; a failed job waits, twice as
long each time, until its attempts are used up.

``retry_transitions`` works on a table of attempts, ``retry_stream`` on a stream of them; both give the
same rows: job_id, at, status, attempts, reason, next_retry_at. Attempts count in order of (at, seq,
outcome), whatever order they arrive in; repeated rows count once. After a terminal state (completed;
failed as retries are exhausted or the job was stopped) further attempts of the job mean nothing. A job
whose wait ends before its next attempt becomes pending ("due") at that moment.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightline.sources.tables import read

EPOCH = datetime.datetime(1970, 1, 1)
SCHEMA = "job_id long, at timestamp_ntz, status string, attempts int, reason string, next_retry_at timestamp_ntz"


@dataclass(frozen=True)
class RetryParams:
    """The wait after the n-th failure is ``wait_ms`` * 2^(n-1). A task over a table takes about
    ``task_rows`` attempts, whatever the table's size; this changes no result."""

    max_attempts: int = 3
    wait_ms: int = 30 * 86_400_000
    task_rows: int = 1_000_000


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended attempts of jobs: job_id, seq, at, outcome. Lines that have no outcome yet are none."""
    flag, part = F.col("l_returnflag"), F.col("l_partkey")
    outcome = F.when((flag == "R") & (part % 10 == 0), "stopped").when((flag == "A") & (part % 2 == 0), "completed").when(flag != "N", "failed")
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_partkey").filter("l_returnflag <> 'N'")
    return rows.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_shipdate").alias("at"), outcome.alias("outcome"))


def without_copies(rows: DataFrame, window) -> DataFrame:
    """``rows`` without those that equal the one before them in ``window``."""
    same = [F.lag(c).over(window).eqNullSafe(F.col(c)) for c in ("at", "seq", "outcome")]
    return rows.withColumn("again", same[0] & same[1] & same[2]).filter("NOT again").drop("again")


def retry_transitions(log: DataFrame, as_of: datetime.datetime, params: RetryParams = RetryParams()) -> DataFrame:
    """All transitions up to ``as_of``. Of each job and outcome only the first ``max_attempts`` attempts can
    matter. A job's attempts, copies too, are dealt out by salt and no more than these are kept before they
    come together, so a job with very many attempts is no single task. Partitions are counted out by rows:
    those that Spark chooses let a task's memory grow with the table."""
    order = ["at", "seq", "outcome"]
    rows = log.filter(F.col("at").isNotNull() & (F.col("at") <= F.lit(as_of).cast("timestamp_ntz"))).select("job_id", *order)
    n = max(log.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // params.task_rows))
    salt = F.pmod(F.xxhash64("at", "seq", F.spark_partition_id()), F.lit(n))
    of_salt = Window.partitionBy("job_id", "salt", "outcome").orderBy("at", "seq")
    dealt = without_copies(rows.withColumn("salt", salt).repartition(n, "job_id", "salt"), of_salt)
    some = dealt.withColumn("nth", F.row_number().over(of_salt)).filter(F.col("nth") <= params.max_attempts)
    of_job = Window.partitionBy("job_id").orderBy(*order)
    first = without_copies(some.select("job_id", *order).repartition(n, "job_id"), of_job)
    so_far = of_job.rowsBetween(Window.unboundedPreceding, 0)
    failures = F.sum(F.when(F.col("outcome") == "failed", 1).otherwise(0)).over(so_far).cast("int")
    ends = (F.col("outcome") != "failed") | (F.col("attempts") >= params.max_attempts)
    steps = first.withColumn("attempts", failures).withColumn("ends", ends.cast("int"))
    steps = steps.withColumn("ended", F.sum("ends").over(so_far) - F.col("ends")).withColumn("next_at", F.lead("at").over(of_job)).filter("ended = 0")
    wait = F.make_dt_interval(secs=F.lit(params.wait_ms / 1000) * F.pow(F.lit(2.0), F.col("attempts") - 1))
    steps = steps.withColumn("due", F.when(F.col("ends") == 0, F.col("at") + wait))
    status = F.when(F.col("ends") == 0, "retrying").when(F.col("outcome") == "completed", "completed").otherwise("failed")
    reason = F.when(F.col("outcome") == "stopped", "hard_stop").when((F.col("outcome") == "failed") & (F.col("ends") == 1), "exhausted")
    waited = (F.col("due") <= F.lit(as_of).cast("timestamp_ntz")) & (F.col("next_at").isNull() | (F.col("next_at") > F.col("due")))
    told = F.struct("job_id", "at", status.alias("status"), "attempts", reason.alias("reason"), F.col("due").alias("next_retry_at"))
    pending = F.struct("job_id", F.col("due").alias("at"), F.lit("pending").alias("status"), "attempts", F.lit("due").alias("reason"), F.lit(None).cast("timestamp_ntz").alias("next_retry_at"))
    return steps.select(F.inline(F.when(waited, F.array(told, pending)).otherwise(F.array(told))))


class RetryQueue(StatefulProcessor):
    """Keeps a job's attempts until the watermark has passed them, so that they count in order; a timer
    stands at each attempt and at the end of each wait."""

    def __init__(self, params: RetryParams):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "at long, seq long, outcome string", "seen boolean")
        self.job = handle.getValueState("job", "attempts int, due long, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        over = self.job.exists() and self.job.get()[2]
        for r in rows:
            if not over:
                self.open.updateValue((r["at_ms"], r["seq"], r["outcome"]), (True,))
                self.handle.registerTimer(r["at_ms"])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        failures, due, over = self.job.get() if self.job.exists() else (0, None, False)
        ready = sorted(tuple(k) for k in self.open.keys() if k[0] <= now) if not over else []
        out = []

        def tell(at, status, reason=None, next_at=None):
            out.append(Row(job_id=key[0], at=moment(at), status=status, attempts=failures, reason=reason, next_retry_at=None if next_at is None else moment(next_at)))

        for at, seq, outcome in ready:
            if due is not None and due < at:
                tell(due, "pending", "due")
            due = None
            if outcome == "failed":
                failures += 1
            over = outcome != "failed" or failures >= self.params.max_attempts
            if not over:
                due = at + self.params.wait_ms * 2 ** (failures - 1)
                self.handle.registerTimer(due)
                tell(at, "retrying", None, due)
            else:
                tell(at, "completed" if outcome == "completed" else "failed", {"stopped": "hard_stop", "failed": "exhausted"}.get(outcome))
                break
            self.open.removeKey((at, seq, outcome))
        if due is not None and due <= now:
            tell(due, "pending", "due")
            due = None
        if over:
            self.open.clear()
        self.job.update((failures, due, over))
        return iter(out)

    def close(self) -> None:
        pass


def moment(ms: int) -> datetime.datetime:
    return EPOCH + datetime.timedelta(milliseconds=ms)


def retry_stream(log: DataFrame, params: RetryParams = RetryParams(), late: str = "120 days") -> DataFrame:
    """Transitions as the watermark passes them; attempts that come later than ``late`` go. Times count in
    milliseconds. The session needs the RocksDB state store (``use_rocksdb``) and UTC as time zone."""
    rows = log.filter(F.col("at").isNotNull() & F.col("job_id").isNotNull()).withColumn("event_at", F.col("at").cast("timestamp"))
    rows = rows.withColumn("at_ms", F.unix_millis("event_at")).withWatermark("event_at", late)
    return rows.groupBy("job_id").transformWithState(RetryQueue(params), SCHEMA, "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: The clock of the registered report.
AS_OF = datetime.datetime(2001, 8, 1)


def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retry_transitions(attempts(spark, sf_dir), AS_OF)


#: The same as a walk over each job's attempts, one at a time.
RETRY_SQL = f"""
WITH RECURSIVE log AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY "at", seq, outcome) AS nth, lead("at") OVER (PARTITION BY job_id ORDER BY "at", seq, outcome) AS next_at FROM (
    SELECT DISTINCT l_orderkey AS job_id, l_linenumber::BIGINT AS seq, l_shipdate AS "at",
      CASE WHEN l_returnflag = 'R' AND l_partkey % 10 = 0 THEN 'stopped' WHEN l_returnflag = 'A' AND l_partkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS outcome
    FROM lineitem WHERE l_returnflag <> 'N' AND l_shipdate <= TIMESTAMP '{AS_OF}')
), walk AS (
  SELECT job_id, nth, "at", next_at, CASE outcome WHEN 'failed' THEN 'retrying' WHEN 'stopped' THEN 'failed' ELSE outcome END AS status, CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END AS attempts,
    CASE WHEN outcome = 'stopped' THEN 'hard_stop' END AS reason, CASE WHEN outcome = 'failed' THEN "at" + INTERVAL 30 DAY END AS next_retry_at
  FROM log WHERE nth = 1
  UNION ALL
  SELECT l.job_id, l.nth, l."at", l.next_at,
    CASE WHEN l.outcome = 'completed' THEN 'completed' WHEN l.outcome = 'stopped' OR w.attempts = 2 THEN 'failed' ELSE 'retrying' END,
    w.attempts + CASE WHEN l.outcome = 'failed' THEN 1 ELSE 0 END,
    CASE WHEN l.outcome = 'stopped' THEN 'hard_stop' WHEN l.outcome = 'failed' AND w.attempts = 2 THEN 'exhausted' END,
    CASE WHEN l.outcome = 'failed' AND w.attempts < 2 THEN l."at" + INTERVAL 30 DAY * (w.attempts + 1) END
  FROM walk w JOIN log l ON l.job_id = w.job_id AND l.nth = w.nth + 1 WHERE w.status = 'retrying'
)
SELECT job_id, "at", status, attempts, reason, next_retry_at FROM walk
UNION ALL SELECT job_id, next_retry_at, 'pending', attempts, 'due', NULL FROM walk WHERE status = 'retrying' AND next_retry_at <= TIMESTAMP '{AS_OF}' AND (next_at IS NULL OR next_at > next_retry_at)
"""
