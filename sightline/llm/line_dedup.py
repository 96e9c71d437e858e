"""Operator 9: line deduplication by site-relative frequency, in DataFrame functions only.

For each host, the pages that contain a line are divided by the host's pages; lines above the
boilerplate ratio leave the texts of that host.

Defined cases: a null text stays null, has no lines and counts as a page; pages of a null host stay
unchanged; lines of white space alone are never judged; a line repeated in a page counts once for it; repeated rows
are pages of their own; an empty table gives an empty result; other columns are ignored, so their
names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import materialize, table


@dataclass(frozen=True)
class LineDedupParams:
    """A host has at most its mean number of distinct lines a page / ``ratio`` boilerplate lines."""

    ratio: float = 0.02
    min_pages: int = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _blank(line: Column) -> Column:
    return ~line.rlike("[^ \\t\\n\\x0B\\f\\r]")


def _key(line: Column) -> Column:
    """128 bits stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate(docs: DataFrame, host: str, p: LineDedupParams) -> DataFrame:
    """site, keys: the boilerplate lines of each host that has some."""
    pages = docs.select(F.col(host).alias("site"), "text").filter("site IS NOT NULL")
    lines = pages.select("site", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).filter(~_blank(F.col("line")))
    # a row without a line counts pages, so that both counts come from one shuffle of partial sums
    counts = lines.select("site", _key(F.col("line")).alias("key")).groupBy("site", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= p.min_pages)
    totals = pages.groupBy("site").agg(F.count("*").alias("total"))
    return counts.join(totals, "site").filter(F.col("n") > p.ratio * F.col("total")).groupBy("site").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, host: str = "source", params: LineDedupParams = LineDedupParams()) -> DataFrame:
    """``docs`` with the text cut, n_lines and n_dropped added; no text is shuffled while the list of
    boilerplate lines, whose size is known once written, is below Spark's broadcast threshold."""
    found = materialize(boilerplate(docs, host, params), "boilerplate").withColumnRenamed("site", "__site").withColumnRenamed("keys", "__keys")
    lines = F.coalesce(_lines(F.col("text")), F.array().cast("array<string>"))
    keep = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col("__keys"), _key(x)))
    cut = docs.join(found, docs[host] == found["__site"], "left").withColumn("__kept", F.when(F.col("__keys").isNotNull(), keep).otherwise(lines))
    return cut.withColumns({
        "text": F.when(F.col("text").isNotNull(), F.array_join("__kept", "\n")),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": (F.size(lines) - F.size("__kept")).cast("long"),
    }).drop("__site", "__keys", "__kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", "n_lines", "n_dropped", F.col("text").alias("kept_text"))


OP9_SQL = r"""
WITH lines AS (
  SELECT DISTINCT d.doc_id, d.source, l.line
  FROM documents d, unnest(string_split(d.text, chr(10))) AS l(line)
  WHERE d.source IS NOT NULL AND regexp_matches(l.line, '[^ \t\n\x0B\f\r]')
), totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source
), bad AS (
  SELECT l.source, l.line FROM lines l JOIN totals t USING (source)
  GROUP BY l.source, l.line, t.total HAVING count(*) >= 5 AND count(*) > 0.02::DOUBLE * t.total
), listed AS (SELECT source, list(line) AS bad FROM bad GROUP BY source
), cut AS (
  SELECT d.doc_id, d.source, d.text, coalesce(string_split(d.text, chr(10)), []) AS parts,
         list_filter(coalesce(string_split(d.text, chr(10)), []), lambda x: NOT list_contains(coalesce(b.bad, []), x)) AS kept
  FROM documents d LEFT JOIN listed b USING (source)
)
SELECT doc_id, source, len(parts)::BIGINT AS n_lines, (len(parts) - len(kept))::BIGINT AS n_dropped,
       CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS kept_text
FROM cut
"""
