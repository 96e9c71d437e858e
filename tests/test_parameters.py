"""Parameters of reports: absent ones, ranges and refusals."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import scalars
from sightline.plans.parameters import LogParams, SearchParams, present, query_logs, search_units

SF = "/root/testdata/sf0.001"


def test_present():
    assert present(LogParams(query="  ", surface="", user_id=0)) == {"user_id": 0, "limit": 50, "offset": 0}
    assert LogParams(limit=0, offset=-3).page() == (1, 0) and LogParams(limit=999, offset=7).page() == (100, 7)


@pytest.mark.parametrize("wrong", [{"query": " "}, {"query": "x" * 401}, {"max_results": 0}, {"max_results": 51}, {"min_duration": 3, "max_duration": 2}])
def test_refused(wrong):
    with pytest.raises(ValueError):
        SearchParams(**wrong)


def test_surfaces(spark):
    whole = query_logs(spark, SF, LogParams(limit=100)).collect()
    assert whole == query_logs(spark, SF, LogParams(limit=100, surface="all", query="", user_id=None)).collect()
    assert {r.surface for r in query_logs(spark, SF, LogParams(surface="mcp")).collect()} == {"mcp"}
    assert query_logs(spark, SF, LogParams(offset=10, limit=5)).collect() == whole[10:15]


@pytest.mark.parametrize(("seconds", "text"), [(59, "Just now"), (60, "1m ago"), (3599, "59m ago"), (7200, "2h ago"), (86400, "1d ago"), (604800, "Jan 1")])
def test_relative_time(spark, seconds, text):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    now = at + F.expr(f"INTERVAL {seconds} SECONDS")
    assert spark.range(1).select(scalars.relative_time(at, now)).first()[0] == text


def test_compact(spark):
    row = spark.range(1).select(*[scalars.compact_number(F.lit(x)) for x in (999.4, 1500.0, 2.25e6)], scalars.capitalised(F.lit("failed"))).first()
    assert tuple(row) == ("999", "1.5K", "2.3M", "Failed")


def test_missing_paging_and_no_least_duration(spark):
    assert query_logs(spark, SF, LogParams(limit=None, offset=None)).collect() == query_logs(spark, SF).collect()
    assert search_units(spark, SF, SearchParams(min_duration=0)).count() == search_units(spark, SF).count()
