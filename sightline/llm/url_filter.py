"""Operator 8: URL filters with association rules.

Listed rules decide first. For other URLs, Spark's FP-growth mines combinations of URL tokens from
labelled pages; combinations that imply a bad page with enough confidence, lift and support block
the URLs that contain them, looked up by an inverted index from each combination's rarest token.

Defined cases: a null URL or one without ``://`` has empty host and path and fits no rule; labels
that are null count as good, pages without labels are not mined; several labels of a page make it
bad if any is; an empty table gives an empty result and no labels give no mined rules; repeated rows
are judged each for itself; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import table

BAD = "is:bad"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


@dataclass(frozen=True)
class MiningParams:
    """A URL has seven tokens at most, so there are 2**7 / min_support combinations at most, which
    bounds what is collected and sent to the tasks. A rule counts only if its bad pages exceed what
    the share of bad pages makes expected by ``min_z`` standard deviations."""

    min_support: float = 0.0005
    min_count: int = 5
    min_confidence: float = 0.6
    min_lift: float = 1.5
    min_z: float = 3.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...], what) -> Column:
    """``what`` of the longest fitting rule, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(what(r))) for r in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Scheme, host, registered domain, first path part, file ending, first query key, depth."""
    text = F.coalesce(url, F.lit(""))
    tagged = [
        ("scheme:", F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        ("host:", host),
        ("domain:", F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)),
        ("part:", F.regexp_replace(F.regexp_extract(path, r"^/([^/]*)", 1), "[0-9]+", "0")),
        ("ending:", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)),
        ("key:", F.regexp_extract(text, r"\?([^=&#]*)", 1)),
        ("depth:", F.least(F.size(F.split(path, "/")), F.lit(9)).cast("string")),
    ]
    return F.array_distinct(F.filter(F.array(*[F.when(x != "", F.concat(F.lit(k), x)) for k, x in tagged]), lambda x: x.isNotNull()))


def mine_rules(pages: DataFrame, labels: DataFrame, params: MiningParams = MiningParams()) -> list[tuple[frozenset[str], float]]:
    """Token combinations that imply bad pages, with their confidence."""
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    known = pages.select("page_id", url_tokens(F.col("url"), host, path).alias("items")).join(bad, "page_id")
    baskets = known.select(F.when(F.col("bad") == 1, F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    n = baskets.count()
    if not n:
        return []
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(params.min_support, params.min_count / n)), minConfidence=params.min_confidence).fit(baskets)
    base = F.col("confidence") / F.col("lift")
    z = (F.col("confidence") - base) / F.sqrt(base * (1 - base) / (n * F.col("support") / F.col("confidence")))
    # all pages are bad where base is 1, and then no rule has a lift
    found = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") >= params.min_lift) & (z >= params.min_z)).select("antecedent", "confidence").collect()
    rules = {frozenset(r["antecedent"]): r["confidence"] for r in found}
    # a rule adds nothing to a more general one of no less confidence
    return sorted(((k, c) for k, c in rules.items() if not any(o < k and rules[o] >= c for o in rules)), key=lambda x: (-x[1], sorted(x[0])))


def blocked_by(rules: list[tuple[frozenset[str], float]]):
    """tokens -> whether a mined rule matches; only rules filed under one of the tokens are tried."""
    uses: dict[str, int] = defaultdict(int)
    for tokens, _ in rules:
        for t in tokens:
            uses[t] += 1
    index: dict[str, list[frozenset[str]]] = defaultdict(list)
    for tokens, _ in rules:
        index[min(tokens, key=lambda t: (uses[t], t))].append(tokens)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([any(rule <= own for t in own for rule in index.get(t, ())) for own in map(frozenset, batch)], dtype=bool)

    return run


def filter_urls(pages: DataFrame, mined: list[tuple[frozenset[str], float]], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (whether a mined rule matches)."""
    host, path = F.col("host"), F.col("path")
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hit = F.lit(False)
    if mined:
        run = blocked_by(mined)
        hit = F.pandas_udf(run, "boolean", F.PandasUDFType.SCALAR_ITER)(url_tokens(F.col("url"), host, path))
    judged = urls.withColumns({"rule": fitting_rule(host, path, rules, lambda r: r.text), "by_rule": fitting_rule(host, path, rules, lambda r: r.verdict), "mined": hit})
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, mine_rules(pages, table(spark, sf_dir, "labels")))
