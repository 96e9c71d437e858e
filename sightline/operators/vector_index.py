"""Nearest units of many query units: exact in blocks, or through an index of inverted lists.

Queries and units meet in groups of bounded size: a chunk of units with a block of queries, one matrix
product each, of which only the best k of a query go on. Without an index every chunk meets every block.
With one, units lie in the list of their nearest centroid and a query meets only the lists it probes.
Centroids are learnt from a bounded sample; every unit is indexed. ``exact`` then also probes each list that
could hold a better unit: no unit of a list is nearer than its centroid allows, given the list's radius.

Scores are cosines of vectors of length one, cut to 0..1 and rounded to five decimals; equal scores go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, unit_id long, video long, unit_type string, score double"
ARROW = pa.schema([("query_id", pa.int64()), ("unit_id", pa.int64()), ("video", pa.int64()), ("unit_type", pa.string()), ("score", pa.float64())])
#: Queries multiplied at once inside a task.
AT_ONCE = 64


@dataclass(frozen=True)
class SearchParams:
    """The best ``k`` units of each query, or the best unit of each of ``k`` videos (``per_video``) by the score
    times the ``weights`` of unit types (1 for others). ``chunk`` units and ``block`` queries meet in a group."""

    k: int = 10
    per_video: bool = False
    weights: tuple[tuple[str, float], ...] = ()
    chunk: int = 32_768
    block: int = 16_384


@dataclass(frozen=True)
class IndexParams:
    """``lists`` centroids (0: the square root of the number of units, 4,096 at most) from ``sample`` units in ``rounds``."""

    lists: int = 0
    sample: int = 20_000
    rounds: int = 8
    probes: int = 8


def matrix(table: pa.Table | pa.RecordBatch, name: str = "embedding") -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _rounded(scores: np.ndarray, digits: float) -> None:
    """Halves go up; in place, since a part's scores are a worker's largest array."""
    scores *= digits
    scores += 0.5
    np.floor(scores, out=scores)
    scores /= digits


def _best(p: SearchParams):
    def run(asked: pa.Table, units: pa.Table) -> pa.Table:
        if not asked.num_rows or not units.num_rows:
            return ARROW.empty_table()
        units = units.take(pc.sort_indices(units, [("unit_id", "ascending")]))
        u, ids, videos = matrix(units), units.column("unit_id").to_numpy(), units.column("video").to_numpy()
        types = units.column("unit_type").combine_chunks()
        del units
        weight = np.ones(len(ids))
        for name, w in p.weights:
            weight[np.array([t == name for t in types.to_pylist()], bool)] = w
        found, scores = [], np.empty((min(AT_ONCE, asked.num_rows), len(ids)))
        for start in range(0, asked.num_rows, AT_ONCE):
            part = asked.slice(start, AT_ONCE)
            query_ids, scores = part.column("query_id").to_numpy(), scores[: part.num_rows]
            np.matmul(matrix(part, "query"), u.T, out=scores)
            np.clip(scores, 0, 1, out=scores)
            _rounded(scores, 1e5)
            if p.weights:
                scores *= weight
                _rounded(scores, 1e6)
            scores[query_ids[:, None] == ids] = -1
            where, values = [], []
            for row in scores:
                if p.per_video:
                    order = np.argsort(-row, kind="stable")
                    order = order[np.unique(videos[order], return_index=True)[1]]
                    order = order[np.lexsort((videos[order], -row[order]))][: p.k]
                else:
                    least = np.partition(row, -p.k)[-p.k] if len(row) > p.k else -1
                    order = np.nonzero(row >= least)[0]
                    order = order[np.argsort(-row[order], kind="stable")][: p.k]
                order = order[row[order] >= 0]
                where.append(order)
                values.append(row[order])
            at, asker = np.concatenate(where), np.repeat(query_ids, [len(x) for x in where])
            found.append(pa.RecordBatch.from_arrays([pa.array(asker), pa.array(ids[at]), pa.array(videos[at]), types.take(pa.array(at)), pa.array(np.concatenate(values))], schema=ARROW))
        return pa.Table.from_batches(found, schema=ARROW)

    return run


def meet(units: DataFrame, asked: DataFrame, p: SearchParams) -> DataFrame:
    """The best of each group of ``units`` (list, unit_id, video, unit_type, embedding) and ``asked`` (list, query_id,
    embedding). Large lists are split into chunks and blocks, by counts of lists, so no group outgrows a task."""
    size = lambda rows, n, most: rows.groupBy("list").agg(F.ceil(F.count("*") / most).alias(n))
    sizes = size(units, "chunks", p.chunk).join(size(asked, "blocks", p.block), "list")
    u = units.join(sizes, "list").select("list", F.pmod(F.xxhash64("unit_id"), "chunks").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "unit_id", "video", "unit_type", "embedding")
    q = asked.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("query_id"), "blocks").alias("block"), "query_id", F.col("embedding").alias("query"))
    key = ["list", "chunk", "block"]
    return q.groupBy(*key).cogroup(u.groupBy(*key)).applyInArrow(_best(p), FOUND)


def ranked(found: DataFrame, p: SearchParams) -> DataFrame:
    """The best k of all groups, with ``place`` from 1. Tasks keep k rows of a query before the shuffle."""
    if p.per_video:
        one = F.row_number().over(Window.partitionBy("query_id", "video").orderBy(F.desc("score"), "unit_id"))
        found = found.withColumn("one", one).filter("one = 1").drop("one")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "video" if p.per_video else "unit_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= p.k)


def _usable(units: DataFrame) -> DataFrame:
    return units.filter(F.col("embedding").isNotNull())


def nearest(units: DataFrame, queries: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """Exact: ``units`` (unit_id, video, unit_type, embedding) for ``queries`` (query_id, embedding), itself excluded."""
    one = lambda c: F.pmod(F.xxhash64(c), F.lit(1)).cast("int").alias("list")  # noqa: E731  one list for all, by a column: joins on a constant become nested loops
    found = meet(_usable(units).select(one("unit_id"), "unit_id", "video", "unit_type", "embedding"), _usable(queries).select(one("query_id"), "query_id", "embedding"), params)
    return ranked(found, params)


@dataclass(frozen=True)
class Index:
    """``lists``: units with their list. ``radius``: greatest distance of a list's unit to its centroid."""

    lists: DataFrame
    centroids: np.ndarray
    radius: np.ndarray


def learn(vectors: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Centroids of a sample, by repeated means from evenly spread first ones; a list that loses all keeps its centroid."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = (vectors @ centroids.T - (centroids**2).sum(1) / 2).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, vectors)
        n = np.bincount(near, minlength=lists)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def build_index(units: DataFrame, path: str, params: IndexParams = IndexParams()) -> Index:
    """Every unit with its list, written to ``path``."""
    units, spark = _usable(units), units.sparkSession
    n = units.count()
    lists = min(params.lists or max(1, min(4096, int(n**0.5))), max(n, 1))
    some = units.select("embedding").sample(min(1.0, 1.2 * params.sample / max(n, 1)), 5).limit(params.sample).collect() or units.select("embedding").limit(lists).collect()
    if not some:
        return Index(units.select(F.lit(0).cast("int").alias("list"), "*", F.lit(0.0).alias("apart")), np.zeros((1, 1)), np.zeros(1))
    centroids = learn(np.array([r[0] for r in some], np.float64), min(lists, len(some)), params.rounds)
    half = (centroids**2).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b)
            near = (v @ centroids.T - half).argmax(1)
            apart = np.sqrt(((v - centroids[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *b.columns, pa.array(apart)], ["list", *b.schema.names, "apart"])

    rows = units.select("unit_id", "video", "unit_type", "embedding")
    schema = "list int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", apart double"
    rows.mapInArrow(run, schema).write.parquet(path)
    stored = spark.read.parquet(path)
    radius = np.zeros(len(centroids))
    for r in stored.groupBy("list").agg(F.max("apart").alias("r")).collect():
        radius[r["list"]] = r["r"]
    return Index(stored, centroids, radius)


def _probed(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """list, query_id, embedding: the lists whose centroids are nearest to a query."""
    centroids, half = index.centroids, (index.centroids**2).sum(1) / 2
    probes = min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.argpartition(-(matrix(b) @ centroids.T - half), probes - 1, axis=1)[:, :probes]
            at = pa.array(np.repeat(np.arange(b.num_rows), probes))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column("query_id").take(at), b.column("embedding").take(at)], ["list", "query_id", "embedding"])

    return queries.select("query_id", "embedding").mapInArrow(run, "list int, query_id long, embedding array<float>")


def _others(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """Lists beyond the probed ones that can hold a unit as good as the query's k-th so far (``least``)."""
    centroids, half, radius = index.centroids, (index.centroids**2).sum(1) / 2, index.radius
    probes = min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b)
            dots = q @ centroids.T
            bound = dots + np.sqrt((q**2).sum(1))[:, None] * radius
            can = np.floor(np.clip(bound + 1e-9, 0, 1) * 1e5 + 0.5) / 1e5 >= b.column("least").to_numpy(zero_copy_only=False)[:, None]
            np.put_along_axis(can, np.argpartition(-(dots - half), probes - 1, axis=1)[:, :probes], False, axis=1)
            at, near = np.nonzero(can)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), b.column("query_id").take(pa.array(at)), b.column("embedding").take(pa.array(at))], ["list", "query_id", "embedding"])

    return queries.select("query_id", "embedding", "least").mapInArrow(run, "list int, query_id long, embedding array<float>")


def search_index(index: Index, queries: DataFrame, params: SearchParams = SearchParams(), probes: int = 8, exact: bool = False) -> DataFrame:
    """The best units of the probed lists; with ``exact`` of all lists. Weights and ``per_video`` need ``nearest``."""
    if params.per_video or params.weights:
        raise ValueError("lists are bounded by plain scores only")
    queries = _usable(queries)
    units = index.lists.drop("apart")
    first = ranked(meet(units, _probed(queries, index, probes), params), params)
    if not exact:
        return first
    least = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == params.k)
    asked = queries.join(least.drop("n"), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
    more = meet(units, _others(asked, index, probes), params)
    return ranked(first.drop("place").unionByName(more), params)
