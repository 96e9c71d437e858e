"""Retrieval in two stages, blended modalities and extractive answers. The second score and the
answer are deterministic stand-ins for models: term overlap, and the best snippets in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.operators.vector_index import IndexParams, SearchParams, build_index, nearest, search_index
from sightline.sources.logical import transcripts, units
from sightline.sources.writes import work_dir

#: Units whose id this number divides are the queries of the registered searches.
EVERY = 50
WEIGHTS = (("speech", 1.0), ("summary", 0.9), ("visual", 0.8))


def query_units(spark: SparkSession, sf_dir: str, every: int = EVERY) -> DataFrame:
    return units(spark, sf_dir).filter(F.col("unit_id") % every == 0).select(F.col("unit_id").alias("query_id"), "embedding")


def vector_search(spark: SparkSession, sf_dir: str, where: str = "TRUE", k: int = 10) -> DataFrame:
    """The best k units that fit ``where`` for each query unit, exact."""
    found = nearest(units(spark, sf_dir).filter(where), query_units(spark, sf_dir), SearchParams(k=k))
    return found.select("query_id", "unit_id", "video", "unit_type", "score")


def result_rank(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The results of each request by score, ranked from 0."""
    found = nearest(units(spark, sf_dir), query_units(spark, sf_dir), SearchParams(k=k))
    return found.select(F.col("query_id").alias("request_id"), "unit_id", (F.col("place") - 1).cast("long").alias("result_rank"))


def indexed_search(spark: SparkSession, sf_dir: str, exact: bool, params: IndexParams = IndexParams(), k: int = 10) -> DataFrame:
    """The same through inverted lists: the probed ones, or as many as an exact result needs."""
    index = build_index(units(spark, sf_dir), work_dir(spark, "index"), params)
    found = search_index(index, query_units(spark, sf_dir), SearchParams(k=k), params.probes, exact)
    return found.select("query_id", "unit_id", "video", "unit_type", "score")


def best_of(rows: DataFrame, by: list[str], order: list, k: int, place: str = "place") -> DataFrame:
    """The first k rows of each group; Spark keeps k for each group and task before the shuffle."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(place) <= k)


def rerank_for_all(spark: SparkSession, sf_dir: str, terms: tuple[str, ...] = ("the", "and", "of"), first: int = 100, k: int = 10) -> DataFrame:
    """The best ``first`` units by vectors, of these the best ``k`` by the share of terms in the transcript.
    What the vectors find is written, as it says which transcripts are split into words and is then ranked again."""
    path = work_dir(spark, "found")
    vector_search(spark, sf_dir, k=first).write.parquet(path)
    best = spark.read.parquet(path)
    texts = transcripts(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), "text").join(best.select("unit_id").distinct(), "unit_id", "left_semi")
    words = F.array_distinct(F.split(F.lower("text"), r"[ \t\n\f\r]+"))
    shares = texts.select("unit_id", (F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) / len(terms)).alias("share"))
    ranked = best.join(shares, "unit_id", "left").withColumn("rerank_score", F.round(F.coalesce("share", F.lit(0.0)), 6))
    return best_of(ranked, ["query_id"], [F.desc("rerank_score"), F.desc("score"), "unit_id"], k).select("query_id", F.col("place").cast("long").alias("place"), "unit_id", "video", "score", "rerank_score")


def blended_for_all(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The best unit of each video, with weighted modalities."""
    found = nearest(units(spark, sf_dir), query_units(spark, sf_dir), SearchParams(k=k, per_video=True, weights=WEIGHTS))
    return found.select("query_id", "video", "unit_id", "unit_type", F.col("score").alias("blended"))


def answers_for_all(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """The first sentences of the best hits' transcripts, in order of rank."""
    best = rerank_for_all(spark, sf_dir, k=k)
    snippets = transcripts(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), F.regexp_extract("text", r"^[^.!?]*[.!?]?", 0).alias("snippet"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "snippet")))  # k rows of each query
    return best.join(snippets, "unit_id").groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["snippet"]), " ").alias("answer"), F.count("*").alias("sources"))


_SCORED = """SELECT q.vec_id AS query_id, u.vec_id AS unit_id, CAST(u.label AS BIGINT) AS video, CASE u.vec_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'speech' ELSE 'visual' END AS unit_type,
  round(greatest(least(list_sum(list_transform(range(1, len(u.embedding) + 1), lambda i: u.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)), 1), 0), 5) AS score
FROM embeddings u JOIN embeddings q ON q.vec_id % 50 = 0 AND u.vec_id <> q.vec_id"""


def _best_sql(where: str, k: int) -> str:
    return f"""SELECT query_id, unit_id, video, unit_type, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS place FROM ({_SCORED}) WHERE {where}) WHERE place <= {k}"""


FILTER = "unit_type = 'speech' AND video BETWEEN 2 AND 8"
_RERANKED = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, score DESC, unit_id) AS place FROM (
  SELECT s.*, round(coalesce(len(list_intersect(regexp_split_to_array(lower(d.text), '[ \\t\\n\\f\\r]+'), ['the', 'and', 'of'])) / 3, 0), 6) AS rerank_score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS n FROM ({_SCORED})) s LEFT JOIN documents d ON d.doc_id = s.unit_id WHERE n <= 100)"""
QUERIES = {
    "vector_search": vector_search,
    "filtered_search": lambda spark, sf_dir: vector_search(spark, sf_dir, FILTER, 20),
    "result_rank": result_rank,
    "vector_index_search": lambda spark, sf_dir: indexed_search(spark, sf_dir, exact=False),
    "vector_index_exact": lambda spark, sf_dir: indexed_search(spark, sf_dir, exact=True),
    "rerank_search": rerank_for_all,
    "blended_search": blended_for_all,
    "grounded_answer": answers_for_all,
}
ORACLES = {
    "vector_search": _best_sql("TRUE", 10),
    "vector_index_exact": _best_sql("TRUE", 10),
    "result_rank": f"SELECT query_id AS request_id, unit_id, place - 1 AS result_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS place FROM ({_SCORED})) WHERE place <= 10",
    "filtered_search": _best_sql(FILTER, 20),
    "rerank_search": f"SELECT query_id, place, unit_id, video, score, rerank_score FROM ({_RERANKED}) WHERE place <= 10",
    "blended_search": f"""SELECT query_id, video, unit_id, unit_type, blended FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, video) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, video ORDER BY blended DESC, unit_id) AS n FROM (
      SELECT *, round(score * CASE unit_type WHEN 'speech' THEN 1.0 WHEN 'summary' THEN 0.9 ELSE 0.8 END, 6) AS blended FROM ({_SCORED}))) WHERE n = 1) WHERE place <= 10""",
    "grounded_answer": f"""SELECT query_id, string_agg(regexp_extract(d.text, '^[^.!?]*[.!?]?', 0), ' ' ORDER BY place) AS answer, count(*) AS sources
FROM ({_RERANKED}) r JOIN documents d ON d.doc_id = r.unit_id WHERE place <= 3 GROUP BY query_id""",
}
