"""What steps report about themselves: JSON artifacts read as VARIANT, of two generations of field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.tables import read

# The fields and routes of step artifacts.
ROUTES = ("text_only", "embed_only", "annotate")
TIMINGS = ("extraction", "dedup", "filter", "ocr", "prepare", "annotation")
#: Fields that a summary leaves out, as they are shown elsewhere.
SHOWN_ELSEWHERE = (
    "logs", "guidance", "duration_ms", "timeout_seconds", "current_route", "analysis_route", "route_counts", "annotation_frame_count", "total_annotation_frame_count",
    *(f"{t}_time_ms" for t in TIMINGS), *(f"total_{t}_time_ms" for t in TIMINGS),
)
#: Numbers that ``telemetry`` reads of a step's artifacts, and routes.
NUMBERS = ("annotation_frame_count", "total_annotation_frame_count", *(f"{t}_time_ms" for t in TIMINGS), *(f"total_{t}_time_ms" for t in TIMINGS))
TEXTS = ("current_route", "analysis_route")


def _is_number(value: Column) -> Column:
    return F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def read_fields(v: Column) -> Column:
    """What ``telemetry`` reads of a VARIANT, taken out of it in one pass."""
    return F.try_variant_get(v, "$", "struct<route_counts variant, " + ", ".join(f"{name} variant" for name in (*NUMBERS, *TEXTS)) + ">")


def read_numbers(fields: Column) -> Column:
    """Route counts and ``NUMBERS`` in this order; strings, even of digits, and others are none. As one rule over an array
    it stays small in generated code: a method of more than 8,000 bytes is never compiled."""
    found = F.array(*(F.try_variant_get(fields["route_counts"], f"$.{r}", "variant") for r in ROUTES), *(fields[name] for name in NUMBERS))
    return F.transform(found, lambda x: F.when(x.isNotNull() & _is_number(x), F.try_variant_get(x, "$", "double")))


def read_texts(fields: Column) -> Column:
    found = F.array(*(fields[name] for name in TEXTS))
    return F.transform(found, lambda x: F.when(x.isNotNull() & (F.schema_of_variant(x) == "STRING"), F.try_variant_get(x, "$", "string")))


def telemetry(v: Column, numbers: Column | None = None, texts: Column | None = None) -> dict[str, Column]:
    """Route, route counts (0 if not told), frames and times of a step's artifacts, a VARIANT (``F.try_parse_json``). It, its
    ``read_fields``, and of these the numbers and texts should be columns, so that each row is parsed and searched once. A
    total stands before the step's own value."""
    numbers = read_numbers(read_fields(v)) if numbers is None else numbers
    texts = read_texts(read_fields(v)) if texts is None else texts
    number = {name: numbers[i] for i, name in enumerate((*ROUTES, *NUMBERS))}
    return {
        "current_route": F.coalesce(*(F.when(texts[i].isin(*ROUTES), texts[i]) for i in range(len(TEXTS)))),
        **{r: F.coalesce(number[r], F.lit(0.0)) for r in ROUTES},
        "annotation_frames": number["annotation_frame_count"],
        "total_annotation_frames": number["total_annotation_frame_count"],
        **{f"{t}_ms": F.coalesce(number[f"total_{t}_time_ms"], number[f"{t}_time_ms"]) for t in TIMINGS},
    }


def artifact_summary(artifacts: Column, n: int = 2) -> Column:
    """The first ``n`` fields that say something new, as "name: value"; null if there is none. Each step names what the
    one before made once or by a lambda's variable, as an expression named twice may be made twice."""
    fields = F.filter(F.map_entries(F.from_json(artifacts, "map<string,variant>")), lambda e: ~e["key"].isin(*SHOWN_ELSEWHERE))
    texts = F.transform(fields, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), e["value"].cast("string").alias("text")))
    zero = lambda e: e["text"].rlike("^-?[0.]+(E|$)") & _is_number(e["value"]) & (F.try_variant_get(e["value"], "$", "double") == 0)
    told = F.filter(texts, lambda e: e["text"].isNotNull() & (e["text"] != "") & ~zero(e))
    return F.nullif(F.array_join(F.transform(F.slice(told, 1, n), lambda e: F.concat(e["key"], F.lit(": "), e["text"])), " • "), F.lit(""))


def payload_summary(v: Column) -> Column:
    """How many items or fields a payload, a VARIANT, has; what is neither a list nor an object is opaque."""
    counted = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    items, fields = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
    return F.when(items.isNotNull(), counted(F.size(items), "item")).when(fields.isNotNull(), counted(F.size(fields), "field")).otherwise("opaque")


def reported_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, step, artifacts: even steps report by the newer names, odd ones by the older; some report a list,
    nothing or what is no JSON."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    part, frames, text = F.col("l_partkey"), F.col("l_quantity").cast("int"), lambda *c: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in c))
    route = F.when(part % 11 == 0, "unknown").otherwise(F.element_at(F.array(*map(F.lit, ROUTES)), (part % 3 + 1).cast("int")))
    newer = F.to_json(F.struct(
        route.alias("current_route"), F.struct((part % 5).alias("text_only"), (part % 4).alias("embed_only"), (part % 3).alias("annotate")).alias("route_counts"), frames.alias("annotation_frame_count"),
        (part * 10).alias("total_extraction_time_ms"), F.lit(1).alias("extraction_time_ms"), text("w", F.col("l_suppkey").cast("string")).alias("worker"), (F.col("l_linenumber") % 3).alias("retries"),
    ))
    older = F.to_json(F.struct(route.alias("analysis_route"), part.alias("extraction_time_ms"), part.cast("string").alias("ocr_time_ms"), F.lit("").alias("note"), frames.alias("frames"), text("s/", F.col("l_orderkey").cast("string")).alias("url"), F.lit("x").alias("more")))
    told = F.when(part % 13 == 0, "[1]").when(part % 17 == 0, None).when(part % 19 == 0, "{broken").when(F.col("l_linenumber") % 2 == 0, newer).otherwise(older)
    return rows.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("step"), told.alias("artifacts"))


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reported_steps(spark, sf_dir).withColumn("v", F.try_parse_json("artifacts")).withColumn("fields", read_fields(F.col("v")))
    return rows.withColumns({"numbers": read_numbers(F.col("fields")), "texts": read_texts(F.col("fields"))}).drop("fields")


def step_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = telemetry(F.col("v"), F.col("numbers"), F.col("texts"))
    return _read(spark, sf_dir).select("job_id", "step", *(c.alias(n) for n, c in told.items()), artifact_summary(F.col("artifacts")).alias("summary"), payload_summary(F.col("v")).alias("payload"))


def scene_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of each job by route, and its annotated frames."""
    t = telemetry(F.col("v"), F.col("numbers"), F.col("texts"))
    rows = _read(spark, sf_dir).select("job_id", *(t[r].alias(r) for r in ROUTES), F.coalesce(t["total_annotation_frames"], t["annotation_frames"], F.lit(0.0)).alias("frames"))
    return rows.groupBy("job_id").agg(*(F.sum(r).cast("long").alias(r) for r in ROUTES), F.sum("frames").cast("long").alias("annotation_frames"))


QUERIES = {"step_telemetry": step_telemetry, "scene_route_counts": scene_route_counts}
#: The same from the columns, without JSON: ``told`` says which form a step reports in.
_STEPS = """WITH s AS (SELECT *, l_partkey AS p, CASE WHEN l_partkey % 13 = 0 THEN 'list' WHEN l_partkey % 17 = 0 OR l_partkey % 19 = 0 THEN 'none' WHEN l_linenumber % 2 = 0 THEN 'newer' ELSE 'older' END AS told FROM lineitem)"""
ORACLES = {
    "step_telemetry": f"""{_STEPS} SELECT l_orderkey AS job_id, l_linenumber::BIGINT AS step,
  CASE WHEN told IN ('newer', 'older') AND p % 11 <> 0 THEN ['text_only', 'embed_only', 'annotate'][p % 3 + 1] END AS current_route,
  CASE WHEN told = 'newer' THEN p % 5 ELSE 0 END::DOUBLE AS text_only, CASE WHEN told = 'newer' THEN p % 4 ELSE 0 END::DOUBLE AS embed_only, CASE WHEN told = 'newer' THEN p % 3 ELSE 0 END::DOUBLE AS annotate,
  CASE WHEN told = 'newer' THEN floor(l_quantity) END AS annotation_frames, NULL::DOUBLE AS total_annotation_frames,
  CASE told WHEN 'newer' THEN p * 10 WHEN 'older' THEN p END::DOUBLE AS extraction_ms, NULL::DOUBLE AS dedup_ms, NULL::DOUBLE AS filter_ms, NULL::DOUBLE AS ocr_ms, NULL::DOUBLE AS prepare_ms, NULL::DOUBLE AS annotation_ms,
  CASE told WHEN 'newer' THEN 'worker: w' || l_suppkey || CASE WHEN l_linenumber % 3 <> 0 THEN ' • retries: ' || (l_linenumber % 3) ELSE '' END
    WHEN 'older' THEN CASE WHEN floor(l_quantity) <> 0 THEN 'frames: ' || floor(l_quantity)::BIGINT || ' • url: s/' || l_orderkey ELSE 'url: s/' || l_orderkey || ' • more: x' END END AS summary,
  CASE told WHEN 'list' THEN '1 item' WHEN 'none' THEN 'opaque' ELSE '7 fields' END AS payload FROM s""",
    "scene_route_counts": f"""{_STEPS} SELECT l_orderkey AS job_id, coalesce(sum(p % 5) FILTER (WHERE told = 'newer'), 0)::BIGINT AS text_only, coalesce(sum(p % 4) FILTER (WHERE told = 'newer'), 0)::BIGINT AS embed_only,
  coalesce(sum(p % 3) FILTER (WHERE told = 'newer'), 0)::BIGINT AS annotate, coalesce(sum(floor(l_quantity)) FILTER (WHERE told = 'newer'), 0)::BIGINT AS annotation_frames FROM s GROUP BY l_orderkey""",
}
