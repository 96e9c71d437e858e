"""Joins of intervals that overlap, in bins of time: a key with very many intervals is spread over its bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _binned(rows: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """Each row in every bin that [start, end) touches; empty intervals are in none."""
    first, last = (F.floor(F.unix_seconds(x.cast("timestamp")) / width) for x in (start, end - F.expr("INTERVAL 1 MICROSECOND")))
    return rows.filter(start < end).withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(first, last)))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int, condition: str = "TRUE") -> DataFrame:
    """Pairs of ``left`` and ``right`` (with columns ``start`` and ``end``) that agree in ``keys`` and overlap, as structs
    ``a`` and ``b``; ``condition`` may name both. A pair is taken once, in the first bin that both touch. ``width`` is in
    seconds: about the length of an interval, so that each is in few bins."""
    a, b = (_binned(rows, F.col("start"), F.col("end"), width).select(*(F.col(k).alias(f"__{s}_{k}") for k in keys), F.col("__bin").alias(f"__{s}_bin"), F.col("__first").alias(f"__{s}_first"), F.struct(*rows.columns).alias(s)) for s, rows in (("a", left), ("b", right)))
    same = [F.col(f"__a_{k}") == F.col(f"__b_{k}") for k in [*keys, "bin"]]
    once = F.col("__a_bin") == F.greatest("__a_first", "__b_first")
    meets = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    pairs = a.join(b, same)
    return pairs.filter(once & meets & F.expr(condition)).select("a", "b")
