"""A report is one SQL statement over the logical tables; Catalyst plans it on Spark, and the same
statement over the DuckDB forms of the tables, which are written independently, is its check."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sightline.sources.logical import DUCKDB, LOGICAL
from sightline.sources.writes import work_dir

#: Tables that take shuffles to make: a report that names one several times writes it first.
WRITTEN = {"impr"}

#: The fixed clock of the reports: the day that events end, and the day that jobs end.
AS_OF, JOBS_AS_OF = "2024-01-30 12:00:00", "2001-08-01 00:00:00"
WEEK, WEEK_BEFORE = "2024-01-24 00:00:00", "2024-01-17 12:00:00"


@dataclass(frozen=True)
class Report:
    """``sql`` names logical tables in braces and timestamps as ts'...'; ``duckdb`` replaces it
    where the dialects differ."""

    sql: str
    duckdb: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        names = re.findall(r"\{(\w+)\}", self.sql)
        tables = {n: LOGICAL[n](spark, sf_dir) for n in set(names)}
        for n in WRITTEN & tables.keys():
            if names.count(n) > 1:  # it would be computed again for each use
                path = work_dir(spark, n)
                tables[n].write.parquet(path)
                tables[n] = spark.read.schema(tables[n].schema).parquet(path)
        return spark.sql(re.sub(r"\bts'", "TIMESTAMP_NTZ'", self.sql), **tables)

    def oracle(self) -> str:
        sql = self.duckdb or self.sql
        order: list[str] = []

        def need(name: str) -> None:
            for other in DUCKDB[name][0]:
                need(other)
            if name not in order:
                order.append(name)

        for name in re.findall(r"\{(\w+)\}", sql):
            need(name)
        prelude = ", ".join(f"{n} AS ({DUCKDB[n][1]})" for n in order)
        body = re.sub(r"\{(\w+)\}", r"\1", re.sub(r"\bts'", "TIMESTAMP '", sql))
        return f"WITH {prelude} SELECT * FROM ({body})" if prelude else body


def callables(reports: dict[str, Report]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: r.run for name, r in reports.items()}
