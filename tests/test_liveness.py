"""Worker liveness as a stream and as a table, with unordered and repeated heartbeats."""

import datetime
import random

from sightline.streaming.liveness import liveness_changes, liveness_stream
from sightline.streaming.retries import use_rocksdb

START = datetime.datetime(2024, 1, 1)
SCHEMA = "worker long, at timestamp_ntz"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def told(df):
    return sorted((r.worker, r.at, r.state) for r in df.collect())


def test_states(spark):
    beats = spark.createDataFrame([(1, at(0)), (1, at(0)), (1, at(60)), (1, at(200)), (2, at(0)), (2, at(301)), (3, at(500)), (None, at(1)), (4, None)], SCHEMA)
    assert told(liveness_changes(beats, at(540))) == [
        (1, at(0), "online"), (1, at(120), "stale"), (1, at(200), "online"), (1, at(260), "stale"), (1, at(500), "offline"),
        (2, at(0), "online"), (2, at(60), "stale"), (2, at(300), "offline"), (2, at(301), "online"), (2, at(361), "stale"), (3, at(500), "online"),
    ]


def test_stream_equals_table(spark, tmp_path):
    use_rocksdb(spark)
    rng = random.Random(2)
    beats = sorted(((w, at(rng.randrange(3000))) for w in range(12) for _ in range(15)), key=lambda r: r[1] + datetime.timedelta(seconds=rng.randrange(50)))
    n = len(beats) // 3
    files = [beats[: n + 9], beats[n:], [*beats[2 * n :], (-1, at(9000))], [(-1, at(9500)), (0, at(0))]]
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = liveness_stream(stream).writeStream.outputMode("append").format("memory").queryName("liveness").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = [x for x in told(spark.table("liveness")) if x[0] >= 0]
    assert got == told(liveness_changes(spark.createDataFrame(beats, SCHEMA), at(8000))) and {x[2] for x in got} == {"online", "stale", "offline"}
