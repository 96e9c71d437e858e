"""Operator 13: exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, which gives its recipe: the ordered list of its chunks'
sizes and hashes. Rows whose recipe nobody shares are alone. Of the others, each distinct chunk is
moved once and compared as text, so that every (size, hash) becomes a verified identifier: where one
stands for several chunks, a number tells them apart. Texts are equal when their lists of verified
identifiers are. Whole documents are never shuffled, and the copies of a hot group meet in partial
sums and in a join that Spark can split.

Defined cases: a null text is an empty one and equals empty texts; of equal texts the row with the
largest id stays, a null id being the smallest, and of rows that repeat this id exactly one; an empty
table gives an empty result; very long texts have long recipes; other columns are ignored, so their
names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import materialize, release, table


@dataclass(frozen=True)
class ChunkParams:
    """Chunks have ``least`` to ``most`` characters, but for the last one. ``anchor`` is a place where
    a chunk may end, found from a few characters around it. Hashes keep ``hash_bits`` bits; results
    do not depend on how many. A list of at most ``broadcast_keys`` numbers goes to all tasks."""

    least: int = 256
    most: int = 8192
    anchor: str = r"(?<=[aeiou\P{ASCII}][nst,.\P{ASCII}]\s)(?=[adip\P{ASCII}])"
    hash_bits: int = 64
    broadcast_keys: int = 1_000_000


def chunks(text: Column, p: ChunkParams) -> Column:
    """The chunks of a text, in order; joined they are the text."""
    pattern = rf"(?s).{{{p.least},{p.most - 1}}}?(?:{p.anchor}|\z)|.{{1,{p.most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _hash(x: Column, p: ChunkParams) -> Column:
    h = F.xxhash64(x)
    return h if p.hash_bits >= 64 else h.bitwiseAND(F.lit(2**p.hash_bits - 1))


def _entry(chunk: Column, p: ChunkParams) -> Column:
    return F.struct(F.octet_length(chunk).alias("size"), _hash(chunk, p).alias("h"))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def recipes(docs: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """row, doc_id, text_sha256, seen (hash of the text), recipe."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(_text().cast("binary"), 256).alias("text_sha256"), _hash(_text(), p).alias("seen"),
        F.transform(chunks(_text(), p), lambda c: _entry(c, p)).alias("recipe"),
    )


def ambiguous_chunks(docs: DataFrame, shared: DataFrame, p: ChunkParams) -> DataFrame:
    """size, h, chunk, number of the chunks of texts in ``shared`` whose size and hash stand for several chunks."""
    texts = docs.select(_hash(_text(), p).alias("seen"), _text().alias("text")).join(shared, "seen", "left_semi")
    distinct = texts.select(F.explode(F.array_distinct(chunks(F.col("text"), p))).alias("chunk")).select(F.inline(F.array(_entry(F.col("chunk"), p))), "chunk").distinct()
    distinct = materialize(distinct, "chunks")
    several = distinct.groupBy("size", "h").agg(F.count("*").alias("n")).filter("n > 1").select("size", "h")
    # texts of one size and hash are as many as hashes collide: none as a rule
    found = distinct.join(several, ["size", "h"]).groupBy("size", "h").agg(F.array_sort(F.collect_list("chunk")).alias("of"))
    found = materialize(found.select("size", "h", F.posexplode("of").alias("number", "chunk")), "ambiguous")
    release(distinct)
    return found


def verified(docs: DataFrame, numbered: DataFrame, p: ChunkParams) -> DataFrame:
    """``recipes`` whose entries have the number that tells chunks of one size and hash apart."""
    kept = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _text().alias("text"))
    rows = materialize(kept, "texts")
    parts = rows.select("row", F.posexplode(chunks(F.col("text"), p)).alias("at", "chunk")).select("row", "at", F.inline(F.array(_entry(F.col("chunk"), p))), "chunk")
    told = parts.join(numbered, ["size", "h", "chunk"], "left").select("row", F.struct("at", "size", "h", F.coalesce("number", F.lit(0)).alias("number")).alias("part"))
    lists = told.groupBy("row").agg(F.array_sort(F.collect_list("part")).alias("recipe"))
    return rows.select("row", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.length("text").cast("long").alias("seen")).join(lists, "row", "left").withColumn("recipe", F.coalesce("recipe", F.array()))


def _shared(rows: DataFrame) -> DataFrame:
    groups = rows.groupBy("seen", "recipe").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep"))
    return groups.filter("group_size > 1")


def exact_groups(docs: DataFrame, params: ChunkParams = ChunkParams()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = materialize(recipes(docs, params), "recipes")
    groups = materialize(_shared(rows), "groups")
    keys = groups.select("seen").distinct()
    numbered = ambiguous_chunks(docs, F.broadcast(keys) if groups.count() <= params.broadcast_keys else keys, params)
    if not numbered.isEmpty():
        rows = materialize(verified(docs, numbered, params), "verified")
        groups = _shared(rows)
    alone = F.col("keep").isNull()
    return rows.join(groups, ["seen", "recipe"], "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"), "text_sha256",
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH g AS (SELECT coalesce(text, '') AS text, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.text) AS text_sha256
FROM documents d JOIN g ON coalesce(d.text, '') = g.text
"""
