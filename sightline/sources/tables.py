"""Readers for the stored tables: explicit columns, missing tables as empty ones, idempotent input."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table at ``path``, or an empty one where nothing is stored; other errors stay errors."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: str, required: tuple[str, ...]) -> DataFrame:
    """JSON rows by an explicit schema; rows whose required fields are missing or mistyped go."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return df.filter(" AND ".join(f"{c} IS NOT NULL" for c in required)) if required else df


def read_jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, low=None, high=None, partitions: int = 5) -> DataFrame:
    """The rows of ``query``; with a numeric or time ``column`` of values from low to high, its range is
    read in parts, else in one task."""
    reader = spark.read.format("jdbc").option("url", url)
    if column is None:
        return reader.option("query", query).load()
    return reader.options(dbtable=f"({query}) AS part", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=partitions).load()


def only_new(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet: appending them twice changes nothing."""
    return incoming.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def after_mark(incoming: DataFrame, column: str, mark) -> DataFrame:
    """Rows beyond the high-water mark; all rows if there is none."""
    return incoming if mark is None else incoming.filter(F.col(column) > F.lit(mark))
