"""Operator 12: whitening of embeddings by a covariance weighted with multiplicities.

Entries become integers, x = floor(scale * c) + shift. Identical x-vectors are grouped first; a distinct
vector enters the sums, the centred product and the projection once, with its count (or one) as weight,
and the results are joined back to the rows. Tasks emit one d x d product each, which Spark adds up; only
such sums, of the size of the dimensions, reach the driver, which takes the eigenvectors.

Defined cases: vectors that are null or hold null or non-finite entries go, and so do vectors of another
length than most (of equally frequent lengths the longer one counts). Rows are kept each for itself, so
ids may be null or repeated. 64 * c is brought into the range of +-9e18. A deviation that does not fit a
long is null. A component without variance has whitened 0.0 and explained 0.0, and has no part in
identity_error. Empty tables and vectors give no row. Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import materialize, release, table

SAFE = 2**62


@dataclass(frozen=True)
class WhiteningParams:
    """``weights``: "count" fits over all vectors, "one" over the distinct ones."""

    scale: float = 64.0
    shift: int = 1_000_000
    components: int = 32
    weights: str = "count"


@dataclass(frozen=True)
class Model:
    """n vectors with sums S; ``axes`` are the columns of the projection, scaled to unit variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x - S/n. The whole part of S/n goes as integers, so nothing is rounded away."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        if x.size and float(np.abs(x.astype(np.float64)).max()) + float(np.abs(whole.astype(np.float64)).max(initial=0)) < SAFE:
            return (x - whole).astype(np.float64) - rest
        return np.array([[float(Fraction(int(v) * self.n - s, self.n)) for v, s in zip(row, self.sums, strict=True)] for row in x], np.float64).reshape(x.shape)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2, exact."""
        if not x.size:
            return []
        most = max(abs(int(x.max())), abs(int(x.min()))) * self.n + max(map(abs, self.sums))
        if most < SAFE:
            apart = x * self.n - np.array(self.sums, np.int64)
            if int(np.abs(apart).max()) ** 2 * x.shape[1] < SAFE:
                return (apart * apart).sum(1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 2**63 else None for v in exact]


def integers(embedding: Column, p: WhiteningParams) -> Column:
    within = lambda c: F.greatest(F.lit(-9e18), F.least(F.lit(9e18), F.lit(p.scale) * c.cast("double")))
    return F.transform(embedding, lambda c: F.floor(within(c)) + F.lit(p.shift).cast("long"))


def usable(embedding: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return F.coalesce(F.forall(embedding, finite), F.lit(False))


def _vectors(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fit_sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and their sums, exact: a task adds its own, Spark adds the tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for b in batches:
            if b.num_rows:
                x, w = _vectors(b, "x", d), b.column("weight").to_numpy()
                small = int(max(abs(int(x.max())), abs(int(x.min())))) * int(w.sum()) < SAFE
                part = (w @ x).tolist() if small else [sum(int(a) * int(v) for a, v in zip(w, x[:, j], strict=True)) for j in range(d)]
                n, sums = n + int(w.sum()), [a + v for a, v in zip(sums, part, strict=True)]
        yield pa.RecordBatch.from_pydict({"n": [n] * d, "at": list(range(d)), "s": pa.array(map(Decimal, sums), pa.decimal128(38, 0))}, pa.schema([("n", pa.int64()), ("at", pa.int32()), ("s", pa.decimal128(38, 0))]))

    rows = distinct.select("x", "weight").mapInArrow(run, "n long, at int, s decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    return rows[0]["n"], [int(r["s"]) for r in sorted(rows, key=lambda r: r["at"])]


def _added(rows: DataFrame, d: int) -> np.ndarray:
    """at, v (array of d) of all tasks -> the d x d sum."""
    flat = rows.select("at", F.posexplode("v").alias("to", "v")).groupBy("at", "to").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for r in flat.collect():
        out[r["at"], r["to"]] = r["v"]
    return out


def _product(y: np.ndarray, total: np.ndarray, w: np.ndarray) -> np.ndarray:
    return total + (y * w[:, None]).T @ y


def _rows(m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(m)), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["at", "v"])


def covariance(distinct: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """Centred first, then multiplied, with weights; divisor n."""
    centred = Model(n, sums, np.zeros((d, 0)), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            total = _product(centred.centre(_vectors(b, "x", d)), total, b.column("weight").to_numpy().astype(np.float64))
        yield _rows(total)

    return _added(distinct.select("x", "weight").mapInArrow(run, "at int, v array<double>"), d) / n


def model_of(v: np.ndarray, n: int, sums: list[int], p: WhiteningParams) -> Model:
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[: p.components]
    least = max(float(values.max(initial=0.0)), 0.0) * len(v) * np.finfo(float).eps
    trace = float(np.trace(v))
    has = [values[k] > least for k in order]
    axes = np.stack([vectors[:, k] / np.sqrt(values[k]) if ok else np.zeros(len(v)) for k, ok in zip(order, has, strict=True)], 1)
    return Model(n, sums, axes, [float(values[k]) / trace if ok else 0.0 for k, ok in zip(order, has, strict=True)])


def whiten(distinct: DataFrame, d: int, model: Model) -> DataFrame:
    """h, x, weight, deviation, whitened of every distinct vector."""
    schema = pa.schema([("h", pa.int64()), ("x", pa.list_(pa.int64())), ("weight", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b, "x", d)
            y = model.centre(x) @ model.axes
            k = y.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(y) * k + 1, k, dtype=np.int32)), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("x").cast(pa.list_(pa.int64())), b.column("weight"), pa.array(model.deviations(x), pa.int64()), lists], schema=schema)

    return distinct.select("h", "x", "weight").mapInArrow(run, "h long, x array<long>, weight long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = model.axes.shape[1]
    has = np.array([bool(np.any(model.axes[:, j])) for j in range(k)], bool)
    if not has.any():
        return 0.0

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, k))
        for b in batches:
            total[0] += b.column("weight").to_numpy().astype(np.float64) @ _vectors(b, "whitened", k)
        yield _rows(total)

    rows = whitened.select("weight", "whitened")
    mean = _added(rows.mapInArrow(means, "at int, v array<double>"), k)[0] / model.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            total = _product(_vectors(b, "whitened", k) - mean, total, b.column("weight").to_numpy().astype(np.float64))
        yield _rows(total)

    apart = np.abs(_added(rows.mapInArrow(run, "at int, v array<double>"), k) / model.n - np.eye(k))
    return float(apart[np.ix_(has, has)].max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_rows(vectors: DataFrame, params: WhiteningParams = WhiteningParams()) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding"), params).alias("x"))
    rows = rows.withColumn("h", F.xxhash64("x"))
    weight = F.count("*") if params.weights == "count" else F.max(F.lit(1).cast("long"))
    distinct = materialize(rows.groupBy("h", "x").agg(weight.alias("weight"), F.count("*").alias("copies")), "vectors")
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or not lengths["d"]:
        return spark.createDataFrame([], RESULT)
    d = lengths["d"]
    fitted = distinct.filter(F.size("x") == d)
    n, sums = fit_sums(fitted, d)
    model = model_of(covariance(fitted, d, n, sums), n, sums, params)
    found = materialize(whiten(fitted, d, model), "whitened")
    error = identity_error(found, model)
    release(distinct)
    explained = F.array(*map(F.lit, model.explained))
    joined = rows.join(found, ["h", "x"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return joined.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(table(spark, sf_dir, "embeddings"))
