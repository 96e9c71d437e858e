"""Operator 7: hierarchical language identification.

Linear support vector machines over hashed byte n-grams predict the language family first; within
it, one machine for each pair of languages votes. They learn from a sample of ``sample`` labelled
documents at most, drawn by a hash of id and language; prediction covers whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a document without an
id is not held out; rows without a language teach nothing, and of rows with one id and language the
least text teaches; with no labelled row all is ``und``; ties go to the language that comes first in
the alphabet; repeated rows are predicted each for itself; an empty table gives an empty result;
other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import table

# Families of ISO 639-1 codes; any other language is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
UND = "und"


@dataclass(frozen=True)
class LanguageParams:
    """``sample`` bounds the labelled rows that are learnt from, ``size`` the hashed features."""

    sample: int = 4000
    size: int = 2048
    rounds: int = 300
    penalty: float = 1e-4


def features(text: str, size: int) -> np.ndarray:
    """Square roots of the shares of hashed byte 1- to 3-grams; words are closed by spaces."""
    raw = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.int64)
    grams = [raw * 31 + 7, (raw[:-1] * 257 + raw[1:]) * 31 + 11, ((raw[:-2] * 257 + raw[1:-1]) * 257 + raw[2:]) * 31 + 13]
    counts = sum(np.bincount((g * 40503 >> 7) % size, minlength=size) / max(1, len(g)) for g in grams)
    return np.sqrt(counts / 3)


def train(x: np.ndarray, y: np.ndarray, p: LanguageParams) -> np.ndarray:
    """Weights (bias last) of a linear machine for y in -1, 1: hinge loss by averaged subgradient
    steps over all rows, classes weighing the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, mean = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(1, p.rounds + 1):
        late = y * (x @ w) < 1
        w = w - 4 / np.sqrt(k) * (p.penalty * w - (weight * y)[late] @ x[late])
        mean += (w - mean) / k
    return mean


def train_pairs(x: np.ndarray, labels: list[str], p: LanguageParams) -> dict[tuple[str, str], np.ndarray]:
    labels = np.array(labels)
    out = {}
    for a, b in combinations(sorted(set(labels.tolist())), 2):
        rows = (labels == a) | (labels == b)
        out[a, b] = train(x[rows], np.where(labels[rows] == a, 1.0, -1.0), p)
    return out


@dataclass(frozen=True)
class Hierarchy:
    families: tuple[str, ...]
    between: dict[tuple[str, str], np.ndarray]
    languages: dict[str, tuple[str, ...]]
    within: dict[str, dict[tuple[str, str], np.ndarray]]
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not any(map(str.isalpha, text)):
            return UND, 0.0
        x = np.append(features(text, self.size), 1.0)
        family, a = vote(self.families, self.between, x)
        lang, b = vote(self.languages[family], self.within[family], x)
        return lang, a * b


def vote(names: tuple[str, ...], pairs: dict[tuple[str, str], np.ndarray], x: np.ndarray) -> tuple[str, float]:
    """The name with most votes, and the mean of its machines' logistic margins."""
    votes: dict[str, int] = dict.fromkeys(names, 0)
    sure: dict[str, list[float]] = defaultdict(list)
    for (a, b), w in pairs.items():
        margin = float(w @ x)
        votes[a if margin >= 0 else b] += 1
        chance = 1 / (1 + np.exp(-4 * margin))
        sure[a].append(chance)
        sure[b].append(1 - chance)
    best = min(names, key=lambda n: (-votes[n], n))
    return best, float(np.mean(sure[best])) if sure[best] else 1.0


def held_out():
    """Documents whose checksum of the id leaves 2 modulo 4 are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def draw(docs: DataFrame, sample: int) -> DataFrame:
    """lang, text of at most ``sample`` labelled rows with least hashes of id and language. The first
    pass reads no text; the second keeps texts that are drawn before it shuffles any."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & (F.col("lang") != UND)).withColumn("k", F.xxhash64("doc_id", "lang"))
    last = known.select("k").distinct().orderBy("k").limit(sample).agg(F.max("k")).first()[0]
    rows = known.filter(F.col("text").isNotNull() & (F.col("k") <= F.lit(last).cast("long")))
    return rows.groupBy("k", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def learn(docs: DataFrame, p: LanguageParams = LanguageParams()) -> Hierarchy:
    """Fit on labelled rows that are not held out; only features leave the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(lang, features(t, p.size).astype("<f4").tobytes()) for lang, t in zip(batch["lang"], batch["text"], strict=True) if any(map(str.isalpha, t))]
            yield pd.DataFrame(rows, columns=["lang", "x"])

    rows = draw(docs, p.sample).mapInPandas(run, "lang string, x binary").collect()
    if not rows:
        return Hierarchy((), {}, {}, {}, p.size)
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in rows]).astype(float)
    langs = [r["lang"] for r in rows]
    family = [FAMILY_OF.get(lang, lang) for lang in langs]
    groups = {f: np.array([k for k, g in enumerate(family) if g == f]) for f in sorted(set(family))}
    within = {f: train_pairs(x[at], [langs[k] for k in at], p) for f, at in groups.items()}
    return Hierarchy(tuple(groups), train_pairs(x, family, p), {f: tuple(sorted({langs[k] for k in at})) for f, at in groups.items()}, within, p.size)


def identify(docs: DataFrame, model: Hierarchy) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [held.value.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [a for a, _ in found], "score": [b for _, b in found]})

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs.select("doc_id", "lang", "text")))
