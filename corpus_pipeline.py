"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of ``documents``.
A stage on nulls, empty texts and repeated rows does what its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import materialize, table
from sightline.llm.decontaminate import contaminated, find_contamination, n_hit_of, without_spans
from sightline.llm.line_dedup import drop_boilerplate
from sightline.llm.near_duplicates import linked_rows, text_key
from sightline.llm.packing import default_tokenizer, pack
from sightline.llm.quality import keep_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(docs).select(*COLUMNS)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source."""
    return drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one that gives the group its id. Of rows that
    repeat its id and text one stays; without an id, of those that have words."""
    rows = materialize(linked_rows(docs), "linked")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    pair = [F.col("doc_id").alias("of_id"), F.col("key").alias("of_key")]
    # what goes is a small part as a rule; once written its size is known, and Spark joins accordingly
    gone = materialize(rows.filter(F.col("first").isNotNull() & ~same).select(*pair).distinct(), "gone")
    again = rows.groupBy("doc_id", "key").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter("c > 1 AND (doc_id IS NOT NULL OR n > 0)")
    repeated = materialize(again.select(*pair), "repeated")
    on = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key"))
    kept = docs.select(*COLUMNS, text_key().alias("key")).join(gone, on, "left_anti")
    once = kept.join(repeated, on, "left_semi").dropDuplicates(["doc_id", "key"])
    return kept.join(repeated, on, "left_anti").unionByName(once).select(*COLUMNS)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark passages are cut out of the others."""
    # ids go as strings, as pandas turns long columns with nulls into floats
    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), "text", F.col("doc_id").cast("string").alias("id"), "lang", "source")
    found = find_contamination(rows, table(spark, sf_dir, "benchmark"), carried=("id", "lang", "source")).withColumn("n_hit", n_hit_of())
    cut = found.filter(~contaminated(F.col("n_hit"), F.col("n_words"))).withColumn("text", without_spans("text", "spans"))
    return cut.withColumn("doc_id", F.col("id").cast("long")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return pack(docs, default_tokenizer())


STAGES = [
    ("quality", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("pack", stage_pack),
]
#: The stages run tokenizers, suffix automata and set joins that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
