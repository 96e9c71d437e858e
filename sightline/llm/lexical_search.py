"""Operator 11: ranked lexical search as a maximum inner product search with norm buckets.

A document is a vector of integer impacts over its terms, an item a vector of term weights, and a score
their inner product. Only terms of items count, so a document's vector is its part over those. Each task
orders its documents by vector length and takes them in buckets: Cauchy-Schwarz ends an item's search at
the first document too short to reach the item's threshold; inside a bucket the item's heaviest coordinates
are multiplied first, and the lengths of what is left bound the rest; survivors are scored exactly in
64-bit integers. Thresholds are the k-th best exact scores so far: of a bounded sample of documents for the
start (a bound only: results do not depend on it), then of the task's own. Items go in blocks of bounded
size, all documents are searched for each, and the best k of the tasks are merged by Spark.

Defined cases: null and empty texts have no terms, so they match nothing and do not count in N; a row of
the items is an item of its own, also with a null or repeated id; among equal scores null doc_ids come
last and rows that repeat an id come in any order; very long texts are split into words piece by piece;
an empty table on either side gives an empty result; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import materialize, release, table

#: A-Z become a-z, what separates terms becomes a space; bytes of characters beyond ASCII stay.
FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
PIECE = 1 << 22
NO_ID = np.iinfo(np.int64).max
FEATURES = "doc_id long, n long, terms array<int>, tfs array<long>"


@dataclass(frozen=True)
class SearchParams:
    """The best ``k`` documents of each item. ``block_terms``: distinct terms of the items searched at once
    (a single item with more is a block of its own). ``bucket``: documents of a bucket. ``focus``: coordinates
    of an item that are multiplied before the others are bounded. ``sample``: documents that give first thresholds."""

    k: int = 50
    block_terms: int = 50_000
    bucket: int = 2048
    focus: int = 8
    sample: int = 8192


def terms_of(text: str | None) -> tuple[Counter, int]:
    """Terms of a whole text with their occurrences, and how many they are."""
    if not text:
        return Counter(), 0
    raw = text.encode("utf-8", "surrogatepass").translate(FOLD)
    if len(raw) <= PIECE:
        words = raw.split()
        return Counter(words), len(words)
    found, at, n = Counter(), 0, 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        words = raw[at:end].split()
        found.update(words)
        n, at = n + len(words), end
    return found, n


def item_terms(items: DataFrame) -> DataFrame:
    """row, item_id, term: each term of an item once."""
    numbered = items.select(F.monotonically_increasing_id().alias("row"), "item_id", "text")  # before terms make more rows of one
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.split(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    return numbered.select("row", "item_id", F.explode(words).alias("term")).filter("term <> ''")


def blocks_of(found: DataFrame, limit: int) -> DataFrame:
    """row, block: items dealt to blocks whose terms are at most ``limit``, as their running sum goes."""
    sizes = found.groupBy("row").agg(F.count("*").alias("size"))
    # sums of ranges of 4,096 rows first, so that no window runs over all items
    sizes = sizes.withColumn("range", F.floor(F.col("row") / 4096))
    ranges = sizes.groupBy("range").agg(F.sum("size").alias("sum"))
    before = ranges.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("before"))
    running = F.sum("size").over(Window.partitionBy("range").orderBy("row")) - F.col("size") + F.col("before")
    return sizes.join(before, "range").select("row", F.floor(2 * running / limit).alias("block"))


@dataclass(frozen=True)
class Block:
    """Items of a block with their terms as numbers; ``weights`` of the terms, 0 where no document has one."""

    rows: list[int]
    items: list[np.ndarray]
    vocabulary: dict[bytes, int]


def block_of(pairs: list) -> Block:
    vocabulary: dict[bytes, int] = {}
    of: dict[int, list[int]] = {}
    for r in pairs:
        of.setdefault(r["row"], []).append(vocabulary.setdefault(r["term"].encode("utf-8", "surrogatepass"), len(vocabulary)))
    return Block(list(of), [np.array(sorted(x), np.int32) for x in of.values()], vocabulary)


def features(docs: DataFrame, block: Block) -> DataFrame:
    """Documents with a term: n, and which terms of the block they hold how often."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, ns, offsets, terms, tfs = [], [], [0], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                counts, n = terms_of(text.as_py())
                if n:
                    held = counts.keys() & known.keys()
                    terms += [known[w] for w in held]
                    tfs += [counts[w] for w in held]
                    ids.append(doc_id.as_py())
                    ns.append(n)
                    offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)


def holders(rows: DataFrame, v: int) -> np.ndarray:
    """df of each of the block's v terms; a task counts its documents, Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(v, np.int64)
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=v)
        held = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], ["term", "df"])

    out = np.zeros(v, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


@dataclass(frozen=True)
class Weights:
    """What scores need of the corpus: documents with terms N, their terms L, and each term's weight."""

    n_docs: int
    n_terms: int
    weight: np.ndarray

    @staticmethod
    def of(n_docs: int, n_terms: int, df: np.ndarray) -> Weights:
        return Weights(n_docs, n_terms, np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) if x else 0 for x in df.tolist()], np.int64))

    def impacts(self, n: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """(10^9 tf) div (1000 tf + 20 m), with n of the document at each place."""
        m = 50 + (50 * n * self.n_docs) // self.n_terms
        return (1_000_000_000 * tfs) // (1000 * tfs + 20 * m)


class Bucket:
    """Some documents, longest first: their entries by document and by term."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, norms: np.ndarray, root: np.ndarray):
        self.ids, self.offsets, self.terms, self.impacts, self.norms = ids, offsets, terms, impacts, norms
        doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        self.by_term, self.doc = terms[order], doc[order]
        self.value = impacts[order] * root[self.by_term]

    def survivors(self, focus: np.ndarray, root: np.ndarray, rest: float, threshold: float, upto: int) -> np.ndarray:
        """Of the first ``upto`` documents those whose focus coordinates, and what is left of both lengths, can reach the threshold."""
        part, square = np.zeros(upto), np.zeros(upto)
        starts, ends = np.searchsorted(self.by_term, focus), np.searchsorted(self.by_term, focus, "right")
        for t, a, b in zip(focus.tolist(), starts.tolist(), ends.tolist(), strict=True):
            b = a + int(np.searchsorted(self.doc[a:b], upto))
            of, v = self.doc[a:b], self.value[a:b]
            part[of] += v * root[t]
            square[of] += v * v
        left = np.sqrt(np.maximum(self.norms[:upto] ** 2 * (1 + 1e-9) - square, 0))
        return np.nonzero((part + left * rest) * (1 + 1e-9) + 1e-6 >= threshold)[0]

    def scores(self, of: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``weight`` is 0 for terms that the item lacks."""
        lengths = self.offsets[of + 1] - self.offsets[of]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[of] - (ends - lengths), lengths)
        total = np.concatenate(([0], np.cumsum(weight[self.terms[at]] * self.impacts[at])))
        return total[ends] - total[ends - lengths]


class Best:
    """The best k documents of one item so far, and the score that others must reach."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold = k, max(threshold, 1)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        take = score >= self.threshold
        if take.any():
            score, ids = np.concatenate((self.score, score[take])), np.concatenate((self.id, ids[take]))
            order = np.lexsort((ids, -score))[: self.k]
            self.score, self.id = score[order], ids[order]
            if len(order) == self.k:
                self.threshold = max(self.threshold, int(self.score[-1]))


def with_norms(rows: DataFrame, w: Weights) -> DataFrame:
    """doc_id, terms, impacts, norm of the documents that hold a term with weight."""
    root = np.sqrt(w.weight.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("terms")
            lengths = np.diff(lists.offsets.to_numpy())
            terms, tfs = lists.flatten().to_numpy(), b.column("tfs").flatten().to_numpy()
            impacts = w.impacts(np.repeat(b.column("n").to_numpy(), lengths), tfs)
            squares = np.concatenate(([0.0], np.cumsum((impacts * root[terms]) ** 2)))
            ends = np.cumsum(lengths)
            norms = np.sqrt(np.maximum(squares[ends] - squares[ends - lengths], 0) + 1e-12 * squares[-1])
            at = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(terms)), pa.ListArray.from_arrays(at, pa.array(impacts)), pa.array(norms)], ["doc_id", "terms", "impacts", "norm"])

    return rows.filter(F.size("terms") > 0).mapInArrow(run, "doc_id long, terms array<int>, impacts array<long>, norm double")


def best_of_tasks(rows: DataFrame, block: Block, w: Weights, p: SearchParams, thresholds: dict[int, int]) -> DataFrame:
    """row, doc_id, score: the best k documents of each task for each item that reach the item's threshold."""
    root = np.sqrt(w.weight.astype(np.float64))
    asks = []
    for row, terms in zip(block.rows, block.items, strict=True):
        terms = terms[np.argsort(-w.weight[terms], kind="stable")]
        terms = terms[w.weight[terms] > 0]
        asks.append((row, terms, float(np.sqrt(w.weight[terms].sum())), float(np.sqrt(w.weight[terms[p.focus :]].sum())), thresholds.get(row, 1)))
    asks = [a for a in asks if len(a[1])]
    shared = rows.sparkSession.sparkContext.broadcast((asks, w.weight, root))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
        root = shared.value[2]
        for batch in batches:
            for start in range(0, batch.num_rows, p.bucket):
                b = batch.slice(start, p.bucket)
                lists = b.column("terms")
                offsets = lists.offsets.to_numpy()
                ids = b.column("doc_id").fill_null(NO_ID).to_numpy()
                yield Bucket(ids, offsets - offsets[0], lists.flatten().to_numpy(), b.column("impacts").flatten().to_numpy(), b.column("norm").to_numpy(), root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, weight, root = shared.value
        best = [Best(p.k, a[-1]) for a in asks]
        mine = np.zeros(len(weight), np.int64)
        for bucket in buckets(batches):
            for (_, terms, length, rest, _), b in zip(asks, best, strict=True):
                if bucket.norms[0] * length * (1 + 1e-9) < b.threshold:
                    continue  # neither this bucket nor a later one can reach the threshold
                upto = int(np.searchsorted(-bucket.norms, -b.threshold / length / (1 + 1e-9), "right"))
                of = bucket.survivors(terms[: p.focus], root, rest, b.threshold, upto)
                if len(of):
                    mine[terms] = weight[terms]
                    b.add(bucket.scores(of, mine), bucket.ids[of])
                    mine[terms] = 0
        row = np.repeat(np.array([a[0] for a in asks], np.int64), [len(b.id) for b in best])
        ids = np.concatenate([b.id for b in best] or [np.zeros(0, np.int64)])
        score = np.concatenate([b.score for b in best] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(ids, mask=ids == NO_ID), pa.array(score)], ["row", "doc_id", "score"])

    return rows.sortWithinPartitions(F.desc("norm")).mapInArrow(run, "row long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """``docs`` (doc_id, text), ``items`` (item_id, text) -> item_id, rank, doc_id, score."""
    p, spark = params, docs.sparkSession
    found = materialize(item_terms(items), "items")
    blocks = materialize(blocks_of(found, p.block_terms), "blocks")
    out, totals = None, None
    for b in [r["block"] for r in blocks.select("block").distinct().orderBy("block").toLocalIterator()]:
        block = block_of(found.join(blocks.filter(F.col("block") == b), "row").select("row", "term").collect())
        rows = materialize(features(docs, block), "features")
        totals = totals or rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not totals["docs"]:
            break
        w = Weights.of(totals["docs"], totals["terms"], holders(rows, len(block.vocabulary)))
        some = rows.sample(min(1.0, p.sample / totals["docs"]), 11) if totals["docs"] > 4 * p.sample else rows.limit(0)
        first = best_of_tasks(with_norms(some.repartition(8), w), block, w, p, {})
        place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))
        thresholds = {r["row"]: r["score"] for r in first.withColumn("place", place).filter(F.col("place") == p.k).collect()}
        part = materialize(best_of_tasks(with_norms(rows, w), block, w, p, thresholds), "best")
        release(rows)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.k)
    return ranked.join(found.select("row", "item_id").distinct(), "row").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH words AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY term),
scored AS (
  SELECT a.item_id, t.doc_id, sum(g.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * s.n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked a JOIN tfs t USING (term) JOIN weights g USING (term) JOIN sizes s USING (doc_id), totals GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""
