"""Display rules, folds over characters, telemetry, windows and interval joins, case by case."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sightline.functions import display, texts
from sightline.operators.intervals import overlapping
from sightline.plans import console, telemetry
from sightline.plans.parameters import SearchParams, search_arguments
from sightline.plans.windows import ReportWindow


def values(spark, column, rows, schema):
    """The column's value for each row, in order."""
    df = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], f"k int, {schema}")
    return [r.v for r in df.select("k", column.alias("v")).orderBy("k").collect()]


def test_durations(spark):
    ms = F.col("ms")
    rows = [None, 0, 499, 59_500, 61_000, 3_600_000, 7_384_000]
    assert values(spark, display.job_duration_text(ms, F.lit(True)), rows, "ms long") == ["Not started", "1s", "1s", "1m 0s", "1m 1s", "1h 0m 0s", "2h 3m 4s"]
    assert values(spark, display.job_duration_text(ms, F.lit(False)), [60_000], "ms long") == ["1m 0s so far"]
    assert values(spark, display.step_duration_text(ms), rows, "ms long") == ["Not recorded", "1s", "1s", "1m 0s", "1m 1s", "60m 0s", "123m 4s"]
    assert values(spark, display.live_duration_text(ms), [-5, 999, 61_999, 7_384_000], "ms long") == ["0s", "0s", "1m 1s", "2h 3m"]
    assert values(spark, display.media_duration_text(ms), [None, 5, 65, 3_661], "ms long") == ["—", "0:05", "1:05", "1:01:01"]
    assert values(spark, display.metric_duration_text(ms), [900, 4200, 8100, 12_200, 61_000, 119_600], "ms long") == ["900ms", "4.2s", "8.1s", "12s", "1m 1s", "1m 60s"]
    assert values(spark, display.request_latency_text(ms), [None, 0.4, 999.4, 1234.0], "ms double") == ["—", "0ms", "999ms", "1.23s"]
    at = datetime.datetime(2024, 1, 1)
    rows = [(None, at, at), (at, at + datetime.timedelta(seconds=2), at), (at, None, at + datetime.timedelta(seconds=1)), (at, None, at - datetime.timedelta(1)), (at, None, None)]
    found = values(spark, display.duration_ms(F.col("a"), F.col("b"), F.col("c")), rows, "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz")
    assert found[1:4] == [2000, 1000, 0]


def test_labels(spark):
    a, b = F.col("a"), F.col("b")
    assert values(spark, display.time_range_label(a, b), [(None, None), (1.0, 2.25), (3.0, None), (None, 4.0)], "a double, b double") == ["—", "1.0s-2.3s", "3.0s", "4.0s"]
    assert values(spark, display.delta_badge(a, b), [(0, 0), (5, 3), (3, 5), (4, 4), (0, 2)], "a long, b long") == [None, "+2", "-2", "0", "-2"]
    assert values(spark, display.top_up_credits(a), [None, float("nan"), 10.0, 1049.0, 1050.0, 2500.0], "a double") == [1000, 1000, 1000, 1000, 1100, 2500]
    assert values(spark, display.billing_action(a, b), [("Free", True), ("enterprise", True), ("Pro", True), ("pro", False)], "a string, b boolean") == ["checkout", None, "portal", None]
    assert values(spark, display.effective_period_end(a, b), [("2024-01-31", "2024-01-15"), ("2024-01-10T05:00:00Z", "2024-01-15"), ("junk", "2024-01-15"), ("2024-01-31", "junk")], "a string, b string") == ["2024-01-15", "2024-01-10", None, "2024-01-31"]
    assert values(spark, display.step_label(a, {"FetchStep": "Fetch media"}), ["FetchStep", "BuildStep", "StepBuild"], "a string") == ["Fetch media", "Build", "StepBuild"]
    admins = F.array(F.lit("x@y.z"))
    assert values(spark, display.is_admin(a, b, admins), [("ADMIN ", None), (None, " X@y.z"), ("user", "q@y.z"), (None, None)], "a string, b string") == [True, True, False, False]


def test_tracking_paths(spark):
    rows = [([],), (None,), (["detail"],), (["x"],), (["r", "1"],), (["r", "1", "go"],), (["r", "1", "x"],), (["a", "b", "c", "d"],)]
    assert values(spark, display.tracked_suffix(F.col("a")), rows, "a array<string>") == ["", "", "/detail", None, "/r/1", "/r/1/go", None, None]
    event = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("-")) for c in display.tracked_event(F.col("a")).values()))
    assert values(spark, event, ["/v/s1", "/v/s1/go", "/v/s1/r/3/detail", "/v/s1/r/x", "/w/s1"], "a string") == ["s1|-|-|redirect", "s1|-|-|outbound_click", "s1|r|3|page_view", "-|-|-|-", "-|-|-|-"]


def test_images(spark):
    import base64

    b64 = lambda raw: base64.b64encode(raw).decode()
    rows = [(None, None), ("https://a/b.png", "xx"), ("https://a/b.png", None), ("ftp://a", None), (None, b64(b"\xff\xd8\xff\xe0rest")), (None, "data:image/png;base64," + b64(b"\x89PNG\r\n\x1a\nrest")), (None, b64(b"RIFF1234WEBPrest")), (None, b64(b"GIF89a")), (None, "***"), (None, b64(b"\xff\xd8\xff" + b"0" * (10 * 2**20)))]
    assert values(spark, display.image_problem(F.col("u"), F.col("b")), rows, "u string, b string") == ["none given", "both given", None, "invalid url", None, None, None, "unknown format", "invalid base64", "too large"]


def test_tool_arguments():
    given = {"query": "q", "max_results": 5, "ranking_mode": "rerank", "include_answer": True, "speaker": None, "published_after": "2024-01-01", "min_duration": 60}
    assert search_arguments(given) == SearchParams(query="q", max_results=5, published_after=datetime.date(2024, 1, 1), min_duration=60)
    for bad in ({"q": 1}, {"ranking_mode": "best"}, {"max_results": 0}, {"published_after": "soon"}):
        with pytest.raises(ValueError):
            search_arguments(bad)


def plain_list(text):
    """The same list by a loop over characters."""

    def cut(value, stop):
        quote, escaped, parts, last = "", False, [], 0
        for i, c in enumerate(value):
            if escaped:
                escaped = False
            elif quote:
                escaped = quote == '"' and c == "\\"
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == stop:
                parts.append(value[last:i])
                last = i + 1
        return [*parts, value[last:]]

    t = cut(text, "#")[0].strip(" ")
    t = t[1:-1] if len(t) >= 2 and t[0] == "[" and t[-1] == "]" else t
    out = []
    for x in cut(t, ","):
        x = cut(x, "#")[0].strip(" ")
        x = None if x in ("", "null", "~") else x[1:-1] if len(x) >= 2 and x[0] == x[-1] and x[0] in "\"'" else x
        x = x and x.strip(" ").lower()
        if x and x not in out:
            out.append(x)
    return out


def test_quoted_lists(spark):
    rng = random.Random(3)
    rows = ["", "[]", "a", "[A, b,a]", '["x, y", \'z#\'] # end', '["q\\", r", s]', "null, ~, k", "a # b, c", "['it''s', \"\"]", None]
    rows += ["".join(rng.choice("ab,'\"\\# []~") for _ in range(rng.randrange(14))) for _ in range(300)]
    assert values(spark, texts.quoted_list(F.col("a")), rows, "a string") == [None if x is None else plain_list(x) for x in rows]


def test_long_quoted_lists(spark):
    """Time grows with the text, not with its length times its values (F1)."""
    text = '["' + 'a,\\"' * 50_000 + "\", 'x', " + "".join(f'"b{k}, c",' for k in range(50_000)) + "] # z"
    began = time.perf_counter()
    [found] = values(spark, texts.quoted_list(F.col("a")), [text], "a string")
    assert found == ['a,\\"' * 50_000, "x", *(f"b{k}, c" for k in range(50_000))]
    assert time.perf_counter() - began < 20


def test_hashes(spark):
    def plain(text):
        h = 0
        raw = text.encode("utf-16-le")
        for k in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[k : k + 2], "little")) % 2**32
        return abs(h - 2**32 if h >= 2**31 else h)

    rows = ["", "a", "search:roadmap", "é日本", "x😀y", "zz" * 500, "polygenelubricants"]
    assert values(spark, texts.string_hash(F.col("a")), rows, "a string") == [plain(x) for x in rows]
    assert values(spark, texts.base36_id(F.col("a")), [35, 36**3, 0], "a long") == ["req_z", "req_1000", "req_0"]


def test_telemetry(spark):
    rows = [
        json.dumps({"current_route": "annotate", "route_counts": {"text_only": 3, "annotate": "2"}, "total_ocr_time_ms": 7, "ocr_time_ms": 1, "dedup_time_ms": 2.5, "zero": 0, "none": None, "empty": "", "worker": "w1", "tries": 2, "more": 1}),
        json.dumps({"analysis_route": "embed_only", "current_route": "other", "route_counts": [1], "annotation_frame_count": "4", "logs": ["x"]}),
        "[1, 2]", "{broken", None, "7",
    ]
    t = telemetry.telemetry(F.try_parse_json("a"))
    told = lambda name: values(spark, t[name], rows, "a string")
    assert told("current_route") == ["annotate", "embed_only", None, None, None, None]
    assert told("text_only") == [3, 0, 0, 0, 0, 0] and told("annotate") == [0] * 6 and told("annotation_frames") == [None] * 6
    assert told("ocr_ms") == [7] + [None] * 5 and told("dedup_ms") == [2.5] + [None] * 5
    assert values(spark, telemetry.artifact_summary(F.col("a")), rows, "a string") == ["worker: w1 • tries: 2", None, None, None, None, None]
    assert values(spark, telemetry.payload_summary(F.try_parse_json("a")), rows, "a string") == ["11 fields", "5 fields", "2 items", "opaque", "opaque", "opaque"]


def test_telemetry_reads_artifacts_once(spark):
    """One pass takes out what is read, and no value is taken out again for each use of it (F5)."""
    for name, most in (("step_telemetry", 16), ("scene_route_counts", 8)):
        plan = telemetry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_json(") + plan.count("parseJson(") == 1 and plan.count("from_json(") <= 1
        assert plan.count("try_variant_get(") <= most


def test_overlaps_of_a_hot_key(spark):
    """A third of all intervals belong to one key; lengths go from nothing to many bins."""
    rng = random.Random(8)
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = []
    for k in range(240):
        start = rng.randrange(3000)
        rows.append((0 if k % 3 == 0 else rng.randrange(1, 20), k, at(start), at(start + rng.choice([0, 1, 30, 60, 500]))))
    df = spark.createDataFrame(rows, "key int, id int, start timestamp_ntz, end timestamp_ntz").repartition(4)
    found = overlapping(df, df, ["key"], 3600, "a.id < b.id").select("a.id", F.col("b.id").alias("other")).collect()
    expected = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]}
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_windows():
    w = ReportWindow.of("7d", datetime.datetime(2026, 3, 30, 12))
    assert (w.current_start, w.current_end, w.previous_start) == (datetime.datetime(2026, 3, 24), datetime.datetime(2026, 3, 30, 12), datetime.datetime(2026, 3, 17, 12))
    assert ReportWindow.of("today", datetime.datetime(2026, 3, 30, 12)).previous_start == datetime.datetime(2026, 3, 29, 12)
    with pytest.raises(ValueError):
        ReportWindow.of("90d")


def test_timeline_ends_at_the_reference_day(spark):
    rows = console.usage_timeline(spark, "/root/testdata/sf0.001", "2024-01-03", "2024-01-20", "2024-01-05T10:00:00Z").orderBy("day").collect()
    assert [(r.short_label, r.full_label) for r in rows] == [("1/3", "Jan 3"), ("1/4", "Jan 4"), ("1/5", "Jan 5")]
    assert console.usage_timeline(spark, "/root/testdata/sf0.001", "2024-01-03", "junk").count() == 0
