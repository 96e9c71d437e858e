"""Operator 1: quality rules by distribution divergence.

Every document's character-class and common-word histograms are compared with the reference of its
language by Jensen-Shannon distance (base 2, 0 to 1). The references are sums over all documents.

Defined cases: a null text has no words and fails the base rules; a null or empty language is held
against the pooled reference of all documents; a language with fewer words than a reference needs
skips the distances; documents shorter than the length guards skip the
test that the guard protects; repeated rows are judged each for itself; an empty table gives an
empty result; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import SPACES, materialize, release, table, trimmed

SYMBOLS = b"#*$%&|<>"
#: Character classes by byte; UTF-8 lead bytes of non-ASCII characters are one class and
#: continuation bytes count nowhere.
CLASSES = (b"aeiouy", b"bcdfghjklmnpqrstvwxz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:!?'\"()-", bytes(range(0xC0, 0x100)))
POOLED = ""
#: Words are compared in lower case, with punctuation as white space.
PLAIN = bytes.maketrans(b".,;:!?'\"()-", b" " * 11)


@dataclass(frozen=True)
class QualityParams:
    """``common_share``: a word is common in a language if it makes up this share of its words, so
    a language has 1 / common_share common words at most. ``lang_words``: a language has a reference
    from so many words on. ``held_bytes``: references beyond this size are joined, not held by tasks."""

    common_share: float = 0.005
    lang_words: int = 5_000
    held_bytes: int = 4_000_000
    min_chars: int = 200
    min_words: int = 80
    max_char_distance: float = 0.25
    max_word_distance: float = 0.35


def _class_matrix() -> np.ndarray:
    m = np.zeros((256, len(CLASSES) + 1))
    for k, chars in enumerate(CLASSES):
        m[list(chars), k] = 1
    m[:0x80, -1] = m[:0x80].sum(1) == 0
    return m


CLASS_OF = _class_matrix()


def class_histogram(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASS_OF


def common_words(raw: bytes) -> list[bytes]:
    return raw.lower().translate(PLAIN).split()


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(parts) / 2)))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    n = len(words)
    last = dict(zip(words, range(n), strict=True))
    ids = np.fromiter(map(last.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * n + ids[1:]
    if n >= 2**20:  # keep the packed window below 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * n + ids[2:]
    order = np.argsort(keys)
    twice = np.diff(keys[order]) == 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][twice]] = hit[order[:-1][twice]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= hit
    return int(covered.sum())


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per language: documents (kind d), class counts (c), words (n), and each word's count (w)."""
    words: dict[str, Counter] = defaultdict(Counter)
    fixed: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES) + 3))

    def out() -> pd.DataFrame:
        rows = [(lang, "w", w.decode(errors="replace"), n) for lang, c in words.items() for w, n in c.items()]
        for lang, x in fixed.items():
            rows += [(lang, "d", "", int(x[-1])), (lang, "n", "", int(x[-2])), *((lang, "c", str(k), int(n)) for k, n in enumerate(x[:-2]))]
        words.clear()
        fixed.clear()
        return pd.DataFrame(rows, columns=["lang", "kind", "key", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            lang, raw = lang or POOLED, (text or "").encode()
            found = common_words(raw)
            words[lang].update(found)
            fixed[lang] += np.append(class_histogram(raw), (len(found), 1))
            if len(words[lang]) > 100_000:  # partial sums; Spark adds them up
                yield out()
    yield out()


def references(docs: DataFrame, p: QualityParams) -> DataFrame:
    """lang, class histogram, common words, their histogram with all other words last. The pooled
    reference has the language POOLED."""
    sums = docs.select("lang", "text").mapInPandas(trimmed(_counts), "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "sums")
    try:
        kinds = range(len(CLASSES) + 1)
        fixed = materialize(sums.filter("kind <> 'w'").groupBy("lang").agg(
            F.max(F.when(F.col("kind") == "n", F.col("n"))).alias("total"),
            *[F.max(F.when((F.col("kind") == "c") & (F.col("key") == str(k)), F.col("n"))).alias(f"c{k}") for k in kinds],
        ), "totals")
        pooled = fixed.agg(*[F.sum(c).alias(c) for c in fixed.columns[1:]]).select(F.lit(POOLED).alias("lang"), "*").filter("total IS NOT NULL")
        heads = fixed.filter((F.col("total") >= p.lang_words) & (F.col("lang") != POOLED)).unionByName(pooled)
        words = sums.filter("kind = 'w'").select("lang", "key", "n")
        all_words = words.groupBy("key").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "key", "n")
        # at most 1 / common_share rows for each language
        shares = lambda w, of: w.join(of.select("lang", "total"), "lang").filter(F.col("n") >= p.common_share * F.col("total")).drop("total")
        common = shares(words.filter(F.col("lang") != POOLED), heads.filter(F.col("lang") != POOLED)).unionByName(shares(all_words, pooled))
        lists = common.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("found"))
        other = F.col("total") - F.coalesce(F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0))
        return materialize(heads.join(lists, "lang", "left").select(
            "lang", F.array(*[F.coalesce(f"c{k}", F.lit(0)) for k in kinds]).alias("classes"),
            F.coalesce(F.col("found.key"), F.array().cast("array<string>")).alias("words"),
            F.concat(F.coalesce(F.col("found.n"), F.array().cast("array<bigint>")), F.array(other)).alias("counts"),
        ), "references")
    finally:
        release(sums)


Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray]


def as_reference(r) -> Reference:
    return np.array(r["classes"], float), {w.encode(): i for i, w in enumerate(r["words"])}, np.array(r["counts"], float)


def held(refs: DataFrame, p: QualityParams) -> dict[str, Reference] | None:
    """The references by language, or None if they are too large to be held by every task."""
    size = refs.agg(F.sum(F.octet_length(F.array_join("words", " ")) + 16 * F.size("words") + 200)).first()[0] or 0
    return {r["lang"]: as_reference(r) for r in refs.collect()} if size <= p.held_bytes else None


def with_reference(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as ``d``, with the reference of its language as ``ref``."""
    rows = docs.select(F.struct("*").alias("d"))
    key = F.when(F.col("d.lang").isNull(), POOLED).otherwise(F.col("d.lang"))
    return rows.join(refs.select(F.col("lang").alias("key"), F.struct("lang", "classes", "words", "counts").alias("ref")), key == F.col("key"), "left").select("d", "ref")


def last_reference():
    """A function of joined references that keeps the last one it made."""
    lang = made = None

    def of(r) -> Reference | None:
        nonlocal lang, made
        if r is None:
            return None
        if made is None or lang != r["lang"]:
            lang, made = r["lang"], as_reference(r)
        return made

    return of


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(doc_id, text: str | None, ref: Reference | None, p: QualityParams) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = repeated_words(words)
    failed = n < 50 or 100 * repeated > 50 * n
    chars = word = None
    if ref:
        classes, index, hist = ref
        if len(text) >= p.min_chars:
            chars = distance(class_histogram(raw), classes)
        if n >= p.min_words:
            found = Counter(plain := common_words(raw))
            own = np.array([*(found[w] for w in index), 0], float)
            own[-1] = len(plain) - own.sum()
            word = distance(own, hist)
    kept = not failed and (chars or 0) <= p.max_char_distance and (word or 0) <= p.max_word_distance
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return doc_id, n, len(text) - (len(raw) - len(raw.translate(None, SPACES))), symbols, len(lines) - len(set(lines)), repeated, failed, kept, chars, word


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Base figures, distances and the verdict ``kept`` of each document (doc_id, text, lang)."""
    refs = references(docs, params)
    by_lang = held(refs, params)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [judge(i, t, by_lang.get(lang or POOLED), params) for i, t, lang in zip(batch["doc_id"], batch["text"], batch["lang"], strict=True)]
            yield pd.DataFrame(rows, columns=names)

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = last_reference()
        for batch in batches:
            rows = [judge(i, t, of(r), params) for i, t, r in zip(batch["doc_id"], batch["text"], batch["ref"], strict=True)]
            yield pd.DataFrame(rows, columns=names)

    docs = docs.select("doc_id", "text", "lang")
    if by_lang is not None:
        return docs.mapInPandas(trimmed(run), SCHEMA)
    return with_reference(docs, refs).select("d.doc_id", "d.text", "ref").mapInPandas(run_joined, SCHEMA)


def keep_quality(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are, without a shuffle while
    the references are small."""
    refs = references(docs, params)
    by_lang = held(refs, params)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, langs in batches:
            yield pd.Series([judge(None, t, by_lang.get(lang or POOLED), params)[7] for t, lang in zip(texts, langs, strict=True)], dtype=bool)

    def run_joined(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        of = last_reference()
        for texts, found in batches:
            given = [None if r["lang"] is None else r for r in found.to_dict("records")]
            yield pd.Series([judge(None, t, of(r), params)[7] for t, r in zip(texts, given, strict=True)], dtype=bool)

    if by_lang is not None:
        return docs.filter(F.pandas_udf(trimmed(run), "boolean", F.PandasUDFType.SCALAR_ITER)("text", "lang"))
    return with_reference(docs, refs).filter(F.pandas_udf(run_joined, "boolean", F.PandasUDFType.SCALAR_ITER)("d.text", "ref")).select("d.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
