"""Operator 4: resolution of not-modified revisit records.

An as-of join by canonical URL finds each revisit's latest earlier full response; validators are
compared and the headers that a not-modified answer may renew are merged. The time range is cut into
at most ``spans`` buckets: the last response of each (URL, bucket) is carried to later buckets, and
only rows of one bucket meet in a window, so a URL with a third of all captures is still spread.

Defined cases: a null URL or time resolves to nothing; of responses at the same time the one with
the largest record_id counts, one at the revisit's own time does not; a validator that either side
lacks is not compared; repeated records are kept; an empty table gives an empty result; other
columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import table

#: Headers that a not-modified answer renews; all others stay as they were.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and m., path without a trailing slash, query without
    tracking keys; scheme and fragment go."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"\?(.*)$", 1), r"(^|&)(utm_[a-z]*|ref)=[^&]*", ""), r"^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def resolve_revisits(records: DataFrame, spans: int = 4096) -> DataFrame:
    """The revisits of ``records`` (record_id, url, ts long, kind, etag, last_modified, digest,
    headers map) with canonical_url, response_id, status and merged headers."""
    ends = records.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    width = max(1, -(-((ends["b"] or 0) - (ends["a"] or 0) + 1) // spans))
    rows = records.select("record_id", "ts", "kind", "etag", "last_modified", "digest", "headers", canonical_url(F.col("url")).alias("canonical_url"), F.floor((F.col("ts") - F.lit(ends["a"])) / width).alias("bucket"))
    # rows without a URL or time have nothing to meet, so no join or window sees them
    lacking = F.col("canonical_url").isNull() | F.col("ts").isNull()
    response = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    newest = lambda c: F.max_by(c, F.struct(c["ts"], c["record_id"]))  # noqa: E731  maps have no order

    whole = rows.filter(~lacking).withColumn("response", response)
    last = whole.filter("response IS NOT NULL").groupBy("canonical_url", "bucket").agg(newest(F.col("response")).alias("last"))
    # every bucket of a revisit takes part, also where no response lies
    asked = whole.filter("kind = 'revisit'").select("canonical_url", "bucket", F.lit(None).cast(last.schema["last"].dataType).alias("last")).dropDuplicates(["canonical_url", "bucket"])
    by_bucket = Window.partitionBy("canonical_url").orderBy("bucket")
    carried = (
        last.unionByName(asked).groupBy("canonical_url", "bucket").agg(F.first("last", ignorenulls=True).alias("last"))
        .withColumn("carried", F.last("last", ignorenulls=True).over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)))
        .drop("last")
    )
    earlier = Window.partitionBy("canonical_url", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    r, same = F.col("found"), lambda x: F.col(x).isNull() | r[x].isNull() | (F.col(x) == r[x])
    found = whole.join(carried, ["canonical_url", "bucket"], "left").withColumn("found", F.coalesce(newest(F.col("response")).over(earlier), "carried")).filter("kind = 'revisit'")
    wanted = [*rows.columns, "found"]
    found = found.select(wanted).unionByName(rows.filter(lacking & (F.col("kind") == "revisit")).withColumn("found", F.lit(None).cast(found.schema["found"].dataType)).select(wanted))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    renewed = F.map_filter(F.coalesce("headers", none), lambda k, _: F.lower(k).isin(*RENEWED))
    names = F.transform(F.map_keys(renewed), F.lower)
    stored = F.map_filter(F.coalesce(r["headers"], none), lambda k, _: ~F.array_contains(names, F.lower(k)))
    status = F.when(r.isNull(), "no_response").when(same("etag") & same("last_modified") & same("digest"), "resolved").otherwise("validator_mismatch")
    return found.select("record_id", "canonical_url", "ts", status.alias("status"), F.when(status == "resolved", r["record_id"]).alias("response_id"), F.when(status == "resolved", F.map_concat(stored, renewed)).alias("headers"))


CAPTURES = 4


def captures(pages: DataFrame) -> DataFrame:
    """A capture history for each page: a response, then responses or revisits by a checksum."""
    each = pages.select("page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(CAPTURES - 1))).alias("k"))
    draw = (F.col("page_id") * 7 + F.col("k") * 11) % 30
    return each.select(
        (F.col("page_id") * CAPTURES + F.col("k")).alias("record_id"), "url", (F.col("page_id") * 10 + F.col("k")).alias("ts"),
        F.when((F.col("k") > 0) & (draw % 3 != 0), "revisit").otherwise("response").alias("kind"),
        F.concat(F.lit("v"), (F.floor(draw / 10) % 2).cast("string")).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("date"), F.concat(F.lit("t"), F.col("k").cast("string")), F.lit("content-type"), F.concat(F.lit("text/"), (draw % 5).cast("string"))).alias("headers"),
    )


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(table(spark, sf_dir, "pages").select("page_id", "url")))
    return found.select("record_id", "canonical_url", "ts", "status", "response_id", F.col("headers")["date"].alias("date"), F.col("headers")["content-type"].alias("content_type"))


OP4_SQL = r"""
WITH caps AS (
  SELECT page_id * 4 + k AS record_id, url, page_id * 10 + k AS ts, k, (page_id * 7 + k * 11) % 30 AS draw
  FROM pages, range(4) AS r(k)
), bare AS (
  SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM caps
), canon AS (
  SELECT *, regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^(www|m)\.', '') AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         regexp_replace(regexp_replace(regexp_extract(b, '\?(.*)$', 1), '(^|&)(utm_[a-z]*|ref)=[^&]*', '', 'g'), '^&', '') AS query
  FROM bare
), rec AS (
  SELECT record_id, ts, k, draw, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url,
         CASE WHEN k > 0 AND draw % 3 <> 0 THEN 'revisit' ELSE 'response' END AS kind, 'v' || ((draw // 10) % 2)::VARCHAR AS etag
  FROM canon
), matched AS (
  SELECT v.*, r.record_id AS rid, r.etag AS retag, r.draw AS rdraw
  FROM (SELECT * FROM rec WHERE kind = 'revisit') v
  ASOF LEFT JOIN (SELECT * FROM rec WHERE kind = 'response') r ON v.canonical_url = r.canonical_url AND v.ts > r.ts
)
SELECT record_id, canonical_url, ts,
       CASE WHEN rid IS NULL THEN 'no_response' WHEN etag = retag THEN 'resolved' ELSE 'validator_mismatch' END AS status,
       CASE WHEN etag = retag THEN rid END AS response_id,
       CASE WHEN etag = retag THEN 't' || k::VARCHAR END AS date,
       CASE WHEN etag = retag THEN 'text/' || (rdraw % 5)::VARCHAR END AS content_type
FROM matched
"""
