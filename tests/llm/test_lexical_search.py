"""Ranked search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sightline.llm import lexical_search
from sightline.llm.lexical_search import SearchParams, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def expected(docs, items, k):
    """(item_id, rank, score, ids that may stand there) for every item."""
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(rng, n):
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "ÄB", "x1Y", "日本"]
    line = lambda most: rng.choice([" ", "-", "\n", "\x7f"]).join(rng.choice(vocabulary[: rng.randrange(2, 64)]) for _ in range(rng.randrange(most)))
    docs = [(k, line(80)) for k in range(n)] + [(1000 + k, docs_text) for k, docs_text in enumerate([None, "", "...", "w1 w1 W1", "W1-w1_w1", "w59"])]
    docs += [(None, "w3 w4"), (None, "w3 w4"), (5, "w3 w4"), (5, "w3 w4")]
    items = [(k, line(12)) for k in range(25)] + [(100, None), (101, "unknown"), (None, "w3 W4!"), (7, "w1"), (7, "w59 w1")]
    return docs, items


@pytest.mark.parametrize("params", [SearchParams(k=5), SearchParams(k=5, bucket=7, focus=2, block_terms=40, sample=20), SearchParams(bucket=16, focus=1)])
def test_against_all_pairs(spark, params):
    docs, items = corpus(random.Random(3), 300)
    d = spark.createDataFrame([(*x, 1, "t") for x in docs], "doc_id long, text string, n int, terms string").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, row int").repartition(2)
    assert found(search(d, i, params)) == expected(docs, items, params.k)


def test_skewed_words(spark):
    rng = random.Random(9)
    docs = [(k, " ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(1, 60)))) for k in range(3000)]
    items = [(k, docs[37 * k][1]) for k in range(10)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    assert found(search(d, i, SearchParams(k=5, bucket=64, focus=4, sample=500))) == expected(docs, items, 5)


def test_bounds_prune_and_lose_nothing():
    """Lengths and focus coordinates leave every document that reaches the threshold, and few others."""
    rng = np.random.default_rng(4)
    weight = rng.integers(1, 9000, 300)
    root = np.sqrt(weight.astype(float))
    sets = [np.sort(rng.choice(300, rng.integers(1, 40), replace=False)) for _ in range(500)]
    impacts = [rng.integers(1, 10**6, len(s)) for s in sets]
    norms = np.array([np.sqrt(((v * root[s]) ** 2).sum()) for s, v in zip(sets, impacts, strict=True)])
    order = np.argsort(-norms)
    sets, impacts, norms = [sets[k] for k in order], [impacts[k] for k in order], norms[order]
    bucket = lexical_search.Bucket(np.arange(500), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), np.concatenate(sets), np.concatenate(impacts), norms, root)
    asked = np.argsort(-weight)[:12]
    mine = np.zeros(300, np.int64)
    mine[asked] = weight[asked]
    scores = np.array([int((mine[s] * v).sum()) for s, v in zip(sets, impacts, strict=True)])
    assert (bucket.scores(np.arange(500), mine) == scores).all()
    threshold = np.sort(scores)[-5]
    left = bucket.survivors(asked[:6], root, float(np.sqrt(weight[asked[6:]].sum())), float(threshold), 500)
    assert set(np.nonzero(scores >= threshold)[0]) <= set(left.tolist()) and len(left) < 450


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(docs.limit(0), items).count() == 0 and search(docs, items.limit(0)).count() == 0
    assert search(docs.withColumn("text", docs.text.substr(0, 0)), items).count() == 0


def test_long_texts(monkeypatch):
    text = "Añ b-1 " * 3000 + "x" * 5000
    whole = terms_of(text)
    monkeypatch.setattr(lexical_search, "PIECE", 64)
    assert terms_of(text) == whole == (Counter(w.encode() for w in words(text)), 9001)
