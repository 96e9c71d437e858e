"""Whether workers are alive, as a stream: online from a heartbeat on, stale a minute and offline five minutes
after the last one, told by timers when no further heartbeat comes. ``liveness_changes`` gives the same
changes of a table of heartbeats: worker, at, state. Equal times count once; times count in milliseconds."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightline.sources.logical import query_log
from sightline.streaming.retries import moment

SCHEMA = "worker long, at timestamp_ntz, state string"
STALE_MS, OFFLINE_MS = 60_000, 300_000


def _millis(at):
    return F.timestamp_millis(F.unix_millis(at.cast("timestamp"))).cast("timestamp_ntz")


def liveness_changes(beats: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """``beats`` (worker, at) -> changes up to ``as_of``. Only a worker's neighbours in time are compared; each time
    counts once, so a worker that repeats itself is reduced before the shuffle."""
    now = F.lit(as_of).cast("timestamp_ntz")
    once = beats.filter(F.col("at").isNotNull() & F.col("worker").isNotNull()).select("worker", _millis(F.col("at")).alias("at")).filter(F.col("at") <= now).distinct()
    order = Window.partitionBy("worker").orderBy("at")
    near = once.withColumn("before", F.lag("at").over(order)).withColumn("after", F.lead("at").over(order))
    plus = lambda c, ms: F.col(c) + F.expr(f"INTERVAL {ms // 1000} SECONDS")
    passed = lambda ms: (plus("at", ms) <= now) & (F.col("after").isNull() | (F.col("after") > plus("at", ms)))
    online = near.filter(F.col("before").isNull() | (F.col("at") > plus("before", STALE_MS))).select("worker", "at", F.lit("online").alias("state"))
    rows = [near.filter(passed(ms)).select("worker", plus("at", ms).alias("at"), F.lit(state).alias("state")) for ms, state in ((STALE_MS, "stale"), (OFFLINE_MS, "offline"))]
    return online.unionByName(rows[0]).unionByName(rows[1])


class Liveness(StatefulProcessor):
    """Keeps a worker's heartbeats until the watermark has passed them, its last one and its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "at long", "seen boolean")
        self.last = handle.getValueState("last", "at long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.open.updateValue((r["at_ms"],), (True,))
            self.handle.registerTimer(r["at_ms"])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        last, state = self.last.get() if self.last.exists() else (None, None)
        out = []

        def tell(at, new):
            out.append(Row(worker=key[0], at=moment(at), state=new))
            return new

        def wait(state, until):
            if state == "online" and last + STALE_MS < until:
                state = tell(last + STALE_MS, "stale")
            if state == "stale" and last + OFFLINE_MS < until:
                state = tell(last + OFFLINE_MS, "offline")
            return state

        for at in sorted(k[0] for k in self.open.keys() if k[0] <= now):
            if last is not None:
                state = wait(state, at)
            if state != "online":
                state = tell(at, "online")
            last = at
            self.open.removeKey((at,))
        if last is not None:
            state = wait(state, now + 1)
            for ms in (STALE_MS, OFFLINE_MS):
                if last + ms > now:
                    self.handle.registerTimer(last + ms)
            self.last.update((last, state))
        return iter(out)

    def close(self) -> None:
        pass


def liveness_stream(beats: DataFrame, late: str = "1 minute") -> DataFrame:
    """Changes as the watermark passes them; heartbeats later than ``late`` go. Needs what ``retry_stream`` needs."""
    rows = beats.filter(F.col("at").isNotNull() & F.col("worker").isNotNull()).withColumn("event_at", F.col("at").cast("timestamp"))
    rows = rows.withColumn("at_ms", F.unix_millis("event_at")).withWatermark("event_at", late)
    return rows.groupBy("worker").transformWithState(Liveness(), SCHEMA, "Append", "EventTime")


AS_OF = datetime.datetime(2024, 1, 30, 12)


def worker_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every worker; requests stand for heartbeats."""
    return liveness_changes(query_log(spark, sf_dir).select(F.col("user_id").alias("worker"), F.col("created_at").alias("at")), AS_OF)


CHANGES_SQL = f"""
WITH b AS (SELECT DISTINCT user_id AS worker, date_trunc('millisecond', ts)::TIMESTAMP AS "at" FROM events WHERE date_trunc('millisecond', ts) <= TIMESTAMP '{AS_OF}'),
ends AS (SELECT a.worker, a."at", min(c."at") AS after FROM b a LEFT JOIN b c ON c.worker = a.worker AND c."at" > a."at" AND c."at" <= a."at" + INTERVAL 5 MINUTE GROUP BY ALL),
begins AS (SELECT a.worker, a."at" FROM b a WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.worker = a.worker AND c."at" < a."at" AND c."at" >= a."at" - INTERVAL 1 MINUTE))
SELECT worker, "at", 'online' AS state FROM begins
UNION ALL SELECT worker, "at" + INTERVAL 1 MINUTE, 'stale' FROM ends WHERE (after IS NULL OR after > "at" + INTERVAL 1 MINUTE) AND "at" + INTERVAL 1 MINUTE <= TIMESTAMP '{AS_OF}'
UNION ALL SELECT worker, "at" + INTERVAL 5 MINUTE, 'offline' FROM ends WHERE after IS NULL AND "at" + INTERVAL 5 MINUTE <= TIMESTAMP '{AS_OF}'
"""
