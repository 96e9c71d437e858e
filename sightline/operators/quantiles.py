"""Exact quantiles without a group in one task: values are counted, their counts dealt out by ranges of
value, and only the ranges that hold a wanted rank are read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.sources.writes import work_dir


def exact_quantiles(rows: DataFrame, value: str, wanted: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """``by`` and a column for each name in ``wanted`` with that quantile of ``value``, interpolated between
    neighbours. Null and NaN values do not count; a group without others is absent, and without ``by`` there is
    always one row. A value that many rows share is one row after the first sums."""
    spark, path = rows.sparkSession, work_dir(rows.sparkSession, "ranges")
    v = F.col(value).cast("double")
    counts = rows.select(*by, v.alias("v")).filter("v IS NOT NULL AND NOT isnan(v)").groupBy(*by, "v").agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(*by, "v").withColumn("range", F.spark_partition_id())
    ranged.write.partitionBy("range").parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)
    sums = stored.groupBy(*by, "range").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row for each range
    spans = sums.withColumn("upto", F.sum("n").over(group.orderBy("range"))).withColumn("start", F.col("upto") - F.col("n")).withColumn("total", F.sum("n").over(group))
    quantiles = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in wanted.items())))
    spans = spans.withColumn("q", quantiles).select("*", "q.*", (F.col("q.p") * (F.col("total") - 1)).alias("rank")).drop("q", "n", "total")
    lo, hi = F.floor("rank"), F.ceil("rank")
    holds = lambda at: (F.col("start") <= at) & (at < F.col("upto"))
    targets = spans.filter(holds(lo) | holds(hi)).drop("upto")
    ranges = [r[0] for r in targets.select("range").distinct().collect()]  # as many as ranges at most
    within = Window.partitionBy(*by, "range", "name").orderBy("v")
    found = stored.filter(F.col("range").isin(ranges)).join(targets, [*by, "range"])
    found = found.withColumn("upto", F.col("start") + F.sum("n").over(within)).withColumn("start", F.col("upto") - F.col("n"))
    ends = found.groupBy(*by, "name").agg(F.max(F.when(holds(lo), F.col("v"))).alias("a"), F.max(F.when(holds(hi), F.col("v"))).alias("b"), F.max(F.col("rank") - lo).alias("part"))
    return ends.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))).alias(name) for name in wanted))
