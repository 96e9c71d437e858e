"""The credit ledger: which grant pays for which request.

Of each user and day the first requests are free. The others draw on the user's grants, earliest expiry
first: included credits that end with the billing cycle, bonus credits that expire, bought credits that
do not, and last those that auto-recharge buys when a day ends below the threshold. A grant counts from
the day after it is given. What no grant covers is unpaid.

A user's requests never meet in one task: they become running sums over minutes first, the sums of a day
are set against the grants (``walk``: one row for each day and a few grants for each user, whatever the
user's number of requests), and a request finds its grants where its part of the day's running sum
overlaps theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.sources.logical import query_log, users

FIRST_DAY, LAST_DAY = "2024-01-01", 29


@dataclass(frozen=True)
class LedgerParams:
    """``free``: free requests of a user and UTC day. Cycles have ``cycle`` days. ``recharge_every``: every
    so many users have auto-recharge, 0 for none."""

    free: int = 10
    cycle: int = 10
    bonus: int = 20
    bonus_days: int = 14
    threshold: int = 100
    quantity: int = 1000
    recharge_every: int = 3


def running(rows: DataFrame, keys: list[str], part: Column, order: list[str], **sums: Column) -> DataFrame:
    """``rows`` with the running sums of some columns within ``keys``. Rows meet only within a part of their
    key; the parts' totals, which partial sums make before the shuffle, give each part its start."""
    rows = rows.withColumn("__part", part)
    totals = rows.groupBy(*keys, "__part").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__part", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    within = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(starts, [*keys, "__part"])
    for n, c in sums.items():
        out = out.withColumn(n, (F.col(f"__{n}") + F.sum(c).over(within)).cast("long"))
    return out.drop("__part", *(f"__{n}" for n in sums))


def day_of(at: Column) -> Column:
    return F.date_diff(at.cast("date"), F.lit(FIRST_DAY).cast("date"))


def _costs(spark: SparkSession, sf_dir: str, free: int = 10) -> DataFrame:
    """request_id, user_id, created_at, day, cost and the request's number on the user's day."""
    rows = query_log(spark, sf_dir).select("request_id", "user_id", "created_at", "credits", day_of(F.col("created_at")).alias("day"))
    counted = running(rows, ["user_id", "day"], F.date_trunc("minute", "created_at"), ["created_at", "request_id"], request_of_day=F.lit(1))
    return counted.withColumn("cost", F.when(F.col("request_of_day") <= free, F.lit(0)).otherwise(F.col("credits")).cast("long")).drop("credits")


def request_costs(spark: SparkSession, sf_dir: str, p: LedgerParams) -> DataFrame:
    """request_id, user_id, day, cost and the day's running cost after the request."""
    spent = running(_costs(spark, sf_dir, p.free), ["user_id", "day"], F.date_trunc("minute", "created_at"), ["created_at", "request_id"], spent=F.col("cost"))
    return spent.select("request_id", "user_id", "day", "cost", "spent")


def grants(spark: SparkSession, sf_dir: str, p: LedgerParams) -> DataFrame:
    """user_id, kind, usable_from, expires (both days; null: never), credits: at most one for each user, kind and day."""
    events = query_log(spark, sf_dir).select("user_id", "event_type", day_of(F.col("created_at")).alias("day"), "latency_ms")
    bonus = events.filter("event_type = 'signup'").groupBy("user_id", "day").agg((F.count("*") * p.bonus).alias("credits"))
    paid = events.filter("event_type = 'purchase'").groupBy("user_id", "day").agg(F.sum(F.floor("latency_ms")).cast("long").alias("credits"))
    starts = F.explode(F.sequence(F.lit(0), F.lit(LAST_DAY), F.lit(p.cycle))).alias("usable_from")
    each = F.when(F.col("tier") == "BUILDING", 30).when(F.col("tier") == "MACHINERY", 15).otherwise(5).cast("long")
    included = users(spark, sf_dir).select("user_id", F.lit("included").alias("kind"), starts, each.alias("credits"))
    return (
        included.select("user_id", "kind", "usable_from", (F.col("usable_from") + p.cycle).alias("expires"), "credits")
        .unionByName(bonus.select("user_id", F.lit("bonus").alias("kind"), (F.col("day") + 1).alias("usable_from"), (F.col("day") + 1 + p.bonus_days).alias("expires"), "credits"))
        .unionByName(paid.filter("credits > 0").select("user_id", F.lit("paid").alias("kind"), (F.col("day") + 1).alias("usable_from"), F.lit(None).cast("int").alias("expires"), "credits"))
    )


WALK = "user_id long, day int, kind string, usable_from int, expires int, a long, b long, left long"
NEVER = 10**9


def _walk(user: int, days: list, stock: list, p: LedgerParams) -> Iterator[tuple]:
    """Sets one user's days (day, demand) against the user's grants (last day, usable_from, kind, credits), both in
    order: the part [a, b) of the day's running cost that a grant pays, and what is left of it. A row without a day
    tells what a grant that paid nothing has left."""
    pool, used, recharges = 0, set(), p.recharge_every > 0 and user % p.recharge_every == 0
    left = [x[3] for x in stock]
    ends = [None if x[0] == NEVER else x[0] for x in stock]
    for day, demand in days:
        at, balance = 0, 0
        for k, (last, start, kind, _) in enumerate(stock):
            if start <= day < last:
                take = min(left[k], demand - at)
                left[k] -= take
                balance += left[k]
                if take:
                    yield user, day, kind, start, ends[k], at, at + take, left[k]
                    used.add(k)
                    at += take
        take = min(pool, demand - at)
        pool -= take
        if take:
            yield user, day, "recharge", None, None, at, at + take, pool
            at += take
        if at < demand:
            yield user, day, "unpaid", None, None, at, demand, 0
        if recharges and balance + pool < p.threshold:
            pool += p.quantity
    for k, (_, start, kind, _) in enumerate(stock):
        if k not in used:
            yield user, None, kind, start, ends[k], None, None, left[k]
    yield user, None, "recharge", None, None, None, None, pool


def allocation(costs: DataFrame, given: DataFrame, p: LedgerParams) -> DataFrame:
    """``_walk`` of every user. A user's lists have one entry for each day and a few grants for each."""
    demand = costs.groupBy("user_id", "day").agg(F.sum("cost").alias("demand")).filter("demand > 0")
    days = demand.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "demand"))).alias("days"))
    stock = given.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("expires", F.lit(NEVER)).alias("last"), "usable_from", "kind", "credits"))).alias("stock"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [out for r in b.to_pylist() for out in _walk(r["user_id"], [tuple(x.values()) for x in r["days"] or ()], [tuple(x.values()) for x in r["stock"] or ()], p)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in WALK.split(", ")])

    return days.join(stock, "user_id", "full").mapInArrow(run, WALK)


def grant_charges(spark: SparkSession, sf_dir: str, params: LedgerParams = LedgerParams()) -> DataFrame:
    """request_id, user_id, kind, usable_from, expires, charged: each request by the grants that pay for it."""
    costs = request_costs(spark, sf_dir, params)
    paid = allocation(costs, grants(spark, sf_dir, params), params).filter("day IS NOT NULL").drop("left")
    c, g = costs.filter("cost > 0").alias("c"), paid.alias("g")
    start = F.col("c.spent") - F.col("c.cost")
    meets = (F.col("c.user_id") == F.col("g.user_id")) & (F.col("c.day") == F.col("g.day")) & (start < F.col("g.b")) & (F.col("g.a") < F.col("c.spent"))
    charged = F.least("c.spent", "g.b") - F.greatest(start, F.col("g.a"))
    out = c.join(g, meets).select("c.request_id", "c.user_id", "g.kind", "g.usable_from", "g.expires", charged.alias("charged"))
    none = F.lit(None).cast("int")
    return out.unionByName(costs.filter("cost = 0").select("request_id", "user_id", F.lit("free").alias("kind"), none.alias("usable_from"), none.alias("expires"), F.lit(0).cast("long").alias("charged")))


def search_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request costs, and its number on the user's day."""
    return _costs(spark, sf_dir).select("request_id", "user_id", F.col("cost").alias("charged"), "request_of_day")


def wallet_drawdown(spark: SparkSession, sf_dir: str, included: int = 20, bought: int = 100, threshold: int = 100) -> DataFrame:
    """Each request's cost from included and then from extra credits, and whether the balance falls below the threshold."""
    spent = running(_costs(spark, sf_dir), ["user_id"], F.date_trunc("minute", "created_at"), ["created_at", "request_id"], spent=F.col("cost"))
    first = F.least("spent", F.lit(included)) - F.least(F.col("spent") - F.col("cost"), F.lit(included))
    return spent.select("request_id", "user_id", "cost", first.cast("long").alias("from_included"), (F.col("cost") - first).cast("long").alias("from_extra"), (included + bought - F.col("spent") < threshold).alias("recharge"))


def wallet_grants(spark: SparkSession, sf_dir: str, params: LedgerParams) -> DataFrame:
    """What each grant has left at the end: user_id, kind, usable_from, expires, credits."""
    rows = allocation(request_costs(spark, sf_dir, params), grants(spark, sf_dir, params), params).filter("kind <> 'unpaid'")
    return rows.groupBy("user_id", "kind", "usable_from", "expires").agg(F.max_by("left", F.coalesce("day", F.lit(10**6))).alias("credits"))


def wallet_balance(spark: SparkSession, sf_dir: str, params: LedgerParams = LedgerParams(free=0)) -> DataFrame:
    """Credits that a user can spend after the last day, by kind."""
    alive = F.coalesce(F.col("expires") > LAST_DAY, F.lit(True)) & F.coalesce(F.col("usable_from") <= LAST_DAY, F.lit(True))
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds) & alive, F.col("credits"))), F.lit(0)).cast("long")
    rows = wallet_grants(spark, sf_dir, params).groupBy("user_id").agg(of("included").alias("included_remaining"), of("bonus").alias("bonus_remaining"), of("paid", "recharge").alias("paid_remaining"))
    return rows.withColumn("wallet_balance", F.col("included_remaining") + F.col("bonus_remaining") + F.col("paid_remaining"))


def expiring_grants(spark: SparkSession, sf_dir: str, params: LedgerParams = LedgerParams(free=0), within: int = 10) -> DataFrame:
    """Usable credits that expire within some days after the last one; of each user the earliest first."""
    soon = wallet_grants(spark, sf_dir, params).filter((F.col("credits") > 0) & (F.col("usable_from") <= LAST_DAY) & F.col("expires").between(LAST_DAY + 1, LAST_DAY + within))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("expires", "usable_from", "kind"))
    return soon.select("user_id", place.cast("long").alias("place"), F.col("kind").alias("grant_type"), "credits", F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("expires")).alias("expires_at"))


QUERIES = {
    "search_cost": search_cost,
    "wallet_drawdown": wallet_drawdown,
    "grant_charges": grant_charges,
    "grant_charges_metered": lambda spark, sf_dir: grant_charges(spark, sf_dir, LedgerParams(free=0)),
    "wallet_balance": wallet_balance,
    "expiring_grants": expiring_grants,
}


def _ledger_sql(free: int) -> str:
    """The same ledger as a recursion over each user's days, with lists of what is left."""
    return f"""
RECURSIVE req AS (
  SELECT event_id AS request_id, user_id, ts, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS day, 1 + (event_id % 5 = 0)::BIGINT AS credits,
    row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS nth FROM events
), cost AS (
  SELECT *, sum(cost) OVER (PARTITION BY user_id, day ORDER BY ts, request_id)::BIGINT AS spent FROM (SELECT *, CASE WHEN nth <= {free} THEN 0 ELSE credits END::BIGINT AS cost FROM req)
), g AS (
  SELECT c_custkey AS user_id, 'included' AS kind, s AS usable_from, s + 10 AS expires, CASE c_mktsegment WHEN 'BUILDING' THEN 30 WHEN 'MACHINERY' THEN 15 ELSE 5 END AS credits FROM customer, (SELECT unnest([0, 10, 20]) AS s)
  UNION ALL SELECT user_id, 'bonus', day + 1, day + 15, 20 * count(*) FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day FROM events WHERE event_type = 'signup') GROUP BY user_id, day
  UNION ALL SELECT user_id, 'paid', day + 1, NULL, sum(floor(value)) FROM (SELECT user_id, value, date_diff('day', DATE '2024-01-01', ts::DATE) AS day FROM events WHERE event_type = 'purchase') GROUP BY user_id, day HAVING sum(floor(value)) > 0
), lists AS (
  SELECT user_id, list(kind ORDER BY coalesce(expires, 1000000000), usable_from, kind) AS kinds, list(usable_from::INT ORDER BY coalesce(expires, 1000000000), usable_from, kind) AS froms,
    list(coalesce(expires, 1000000000)::INT ORDER BY coalesce(expires, 1000000000), usable_from, kind) AS untils, list(credits::BIGINT ORDER BY coalesce(expires, 1000000000), usable_from, kind) AS amounts FROM g GROUP BY user_id
), days AS (SELECT user_id, day, sum(cost)::BIGINT AS demand, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM cost GROUP BY user_id, day HAVING sum(cost) > 0
), walk AS (
  SELECT user_id, 0::BIGINT AS k, NULL::INT AS day, amounts AS remain, 0::BIGINT AS pool, list_transform(amounts, lambda x: 0::BIGINT) AS took, 0::BIGINT AS pool_took, 0::BIGINT AS demand FROM lists
  UNION ALL
  SELECT user_id, k, day, left_now, pool_now + CASE WHEN user_id % 3 = 0 AND coalesce(list_sum(list_transform(range(1, len(froms) + 1), lambda i: CASE WHEN froms[i] <= day AND day < untils[i] THEN left_now[i] ELSE 0 END)), 0) + pool_now < 100 THEN 1000 ELSE 0 END, took, pool_took, demand FROM (
    SELECT *, list_transform(range(1, len(took) + 1), lambda i: remain[i] - took[i]) AS left_now, pool - pool_took AS pool_now FROM (
      SELECT *, least(pool, demand - coalesce(list_sum(took), 0))::BIGINT AS pool_took FROM (
        SELECT *, list_transform(range(1, len(av) + 1), lambda i: least(av[i], greatest(demand - coalesce(list_sum(av[1:i - 1]), 0), 0))::BIGINT) AS took FROM (
          SELECT w.user_id, d.k, d.day, d.demand, w.remain, w.pool, l.froms, l.untils, list_transform(range(1, len(l.froms) + 1), lambda i: CASE WHEN l.froms[i] <= d.day AND d.day < l.untils[i] THEN w.remain[i] ELSE 0 END) AS av
          FROM walk w JOIN days d ON d.user_id = w.user_id AND d.k = w.k + 1 JOIN lists l ON l.user_id = w.user_id))))
)"""


def _charges_sql(free: int) -> str:
    return f"""WITH {_ledger_sql(free)}, parts AS (
  SELECT user_id, day, kinds[i] AS kind, froms[i] AS usable_from, nullif(untils[i], 1000000000) AS expires, coalesce(list_sum(took[1:i - 1]), 0) AS a, coalesce(list_sum(took[1:i]), 0) AS b FROM walk JOIN lists USING (user_id), range(1, 1000) r(i) WHERE k > 0 AND i <= len(took) AND took[i] > 0
  UNION ALL SELECT user_id, day, 'recharge', NULL, NULL, coalesce(list_sum(took), 0), coalesce(list_sum(took), 0) + pool_took FROM walk WHERE pool_took > 0
  UNION ALL SELECT user_id, day, 'unpaid', NULL, NULL, coalesce(list_sum(took), 0) + pool_took, demand FROM walk WHERE k > 0 AND coalesce(list_sum(took), 0) + pool_took < demand)
SELECT c.request_id, c.user_id, p.kind, p.usable_from, p.expires, (least(c.spent, p.b) - greatest(c.spent - c.cost, p.a))::BIGINT AS charged
FROM cost c JOIN parts p ON c.user_id = p.user_id AND c.day = p.day AND c.spent - c.cost < p.b AND p.a < c.spent WHERE c.cost > 0
UNION ALL SELECT request_id, user_id, 'free', NULL, NULL, 0 FROM cost WHERE cost = 0"""


_LAST = f"WITH {_ledger_sql(0)}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS n FROM walk) JOIN lists USING (user_id) WHERE n = 1), rest AS (SELECT user_id, kinds[i] AS kind, froms[i] AS usable_from, untils[i] AS expires, remain[i] AS credits FROM last, range(1, 1000) r(i) WHERE i <= len(remain))"
_LOG = "SELECT event_id AS request_id, user_id, ts, 1 + (event_id % 5 = 0)::BIGINT AS credits, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events"
ORACLES = {
    "search_cost": f"SELECT request_id, user_id, CASE WHEN n <= 10 THEN 0 ELSE credits END AS charged, n AS request_of_day FROM ({_LOG})",
    "wallet_drawdown": f"""SELECT request_id, user_id, cost, least(spent, 20) - least(spent - cost, 20) AS from_included, cost - (least(spent, 20) - least(spent - cost, 20)) AS from_extra, 120 - spent < 100 AS recharge
FROM (SELECT *, sum(cost) OVER (PARTITION BY user_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM (SELECT *, CASE WHEN n <= 10 THEN 0 ELSE credits END::BIGINT AS cost FROM ({_LOG})))""",
    "grant_charges": _charges_sql(10),
    "grant_charges_metered": _charges_sql(0),
    "wallet_balance": f"""{_LAST}, open AS (SELECT * FROM rest WHERE usable_from <= 29 AND expires > 29)
SELECT user_id, included_remaining, bonus_remaining, paid_remaining, included_remaining + bonus_remaining + paid_remaining AS wallet_balance FROM (
  SELECT l.user_id, coalesce(sum(credits) FILTER (WHERE kind = 'included'), 0)::BIGINT AS included_remaining, coalesce(sum(credits) FILTER (WHERE kind = 'bonus'), 0)::BIGINT AS bonus_remaining, (coalesce(sum(credits) FILTER (WHERE kind = 'paid'), 0) + any_value(l.pool))::BIGINT AS paid_remaining
  FROM last l LEFT JOIN open o ON o.user_id = l.user_id GROUP BY l.user_id)""",
    "expiring_grants": f"""{_LAST}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY expires, usable_from, kind) AS place, kind AS grant_type, credits, DATE '2024-01-01' + expires AS expires_at FROM rest WHERE credits > 0 AND usable_from <= 29 AND expires BETWEEN 30 AND 39""",
}
