"""The retry queue as a stream and as a table, with late, unordered and repeated attempts."""

import datetime
import random

from pyspark.sql import functions as F

from sightline.streaming.retries import RetryParams, retry_stream, retry_transitions, use_rocksdb

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1)
FAR = START + 1000 * DAY
PARAMS = RetryParams(max_attempts=3, wait_ms=86_400_000)
SCHEMA = "job_id long, seq long, at timestamp_ntz, outcome string"


def told(df):
    return sorted((r.job_id, r.at, r.status, r.attempts, r.reason or "", str(r.next_retry_at)) for r in df.collect())


def test_states(spark):
    at = lambda d: START + d * DAY
    rows = [
        (1, 0, at(0), "failed"), (1, 1, at(5), "failed"), (1, 2, at(6), "failed"), (1, 3, at(9), "completed"),  # exhausted, later attempts mean nothing
        (2, 0, at(0), "stopped"), (2, 1, at(1), "completed"), (3, 0, at(0), "failed"), (3, 0, at(0), "failed"), (3, 1, at(1), "completed"), (4, 0, None, "failed"),
    ]
    assert told(retry_transitions(spark.createDataFrame(rows, SCHEMA), at(100), PARAMS)) == sorted([
        (1, at(0), "retrying", 1, "", str(at(1))), (1, at(1), "pending", 1, "due", "None"), (1, at(5), "retrying", 2, "", str(at(7))), (1, at(6), "failed", 3, "exhausted", "None"),
        (2, at(0), "failed", 0, "hard_stop", "None"), (3, at(0), "retrying", 1, "", str(at(1))), (3, at(1), "completed", 1, "", "None"),
    ])
    assert retry_transitions(spark.createDataFrame([], SCHEMA), at(100), PARAMS).count() == 0


def test_stream_equals_table(spark, tmp_path):
    """Three files whose attempts overlap in time; some are repeated, one comes too late for the stream."""
    use_rocksdb(spark)
    rng = random.Random(6)
    rows = [(job, seq, START + rng.randrange(40 * 24) * DAY / 24, rng.choice(["failed"] * 4 + ["completed", "stopped"])) for job in range(40) for seq in range(rng.randrange(1, 6))]
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 9) * DAY)
    n = len(rows) // 3
    files = [rows[: n + 20], rows[n:], [*rows[2 * n :], (-1, 0, FAR, "failed")], [(0, 9, START - DAY, "stopped"), (-2, 0, FAR + DAY, "failed")]]
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    names = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    assert len(names) == 4
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = retry_stream(stream, PARAMS, "10 days")
    query = out.writeStream.outputMode("append").format("memory").queryName("retries").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    got = [x for x in told(spark.table("retries")) if x[0] >= 0]
    expected = told(retry_transitions(spark.createDataFrame(rows, SCHEMA), FAR - 11 * DAY, PARAMS))
    assert got == expected and {x[2] for x in got} == {"retrying", "pending", "completed", "failed"}


def walked(rows, as_of):
    """The transitions of each job, one attempt after another."""
    out, tell = [], lambda *x: out.append((*x[:4], x[4] or "", str(x[5])))
    for job in {r[0] for r in rows}:
        seen = sorted({(r[2], r[1], r[3]) for r in rows if r[0] == job and r[2] <= as_of})
        failures = 0
        for k, (moment, _, outcome) in enumerate(seen):
            failures += outcome == "failed"
            if outcome != "failed" or failures == PARAMS.max_attempts:
                tell(job, moment, "completed" if outcome == "completed" else "failed", failures, {"failed": "exhausted", "stopped": "hard_stop"}.get(outcome), None)
                break
            due = moment + 2 ** (failures - 1) * DAY
            tell(job, moment, "retrying", failures, None, due)
            if due <= as_of and (k + 1 == len(seen) or seen[k + 1][0] > due):
                tell(job, due, "pending", failures, "due", None)
    return sorted(out)


def test_a_task_takes_a_bounded_number_of_attempts(spark):
    """Partitions go by rows, not by ``spark.sql.shuffle.partitions`` (4 here); so do a job of very many
    attempts and copies that every part of the input holds."""
    rng = random.Random(60)
    some = lambda: rng.choice(["failed"] * 4 + ["completed", "stopped"])
    rows = [(job, seq, START + rng.randrange(40 * 24) * DAY / 24, some()) for job in range(2, 600) for seq in range(rng.randrange(1, 6))]
    rows += [(0, seq, START + rng.randrange(30 * 24) * DAY / 24, "failed" if seq % 400 else "completed") for seq in range(2_000)]
    rows += [(1, 5, START + 3 * DAY, "failed")] * 500 + [(1, 6, START + 9 * DAY, "failed")] * 500
    rng.shuffle(rows)
    as_of = START + 35 * DAY
    params = RetryParams(PARAMS.max_attempts, PARAMS.wait_ms, task_rows=100)
    got = retry_transitions(spark.createDataFrame(rows, SCHEMA), as_of, params)
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= 20 and max(per_task) < 300
    assert told(got) == walked(rows, as_of) == told(retry_transitions(spark.createDataFrame(rows, SCHEMA), as_of, PARAMS))
