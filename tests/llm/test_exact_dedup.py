"""Exact deduplication against brute force, also where hashes collide."""

import hashlib
import random
from collections import defaultdict

import pytest

from sightline.llm.chunk_recipes import ChunkParams, chunks, exact_groups

SMALL = ChunkParams(least=4, most=40)


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [x for x in ids if x is not None]
        keep, first = max(known) if known else None, True
        for x in sorted(ids, key=lambda x: (x is None, x)):
            kept = x == keep and first
            first = first and not kept
            out.append((x, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice(["ans", "des", "of", "più", "日本", "x" * 50, "a\n"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    rows = [(k, rng.choice(base)) for k in range(200)] + [(1000 + k, None) for k in range(3)] + [(2000, ""), (None, base[0]), (None, "only"), (None, "only"), (7, "again"), (7, "again"), (3000, base[1] + " ")]
    return [*rows, (4000, "long " * 100_000), (4001, "long " * 100_000), (4002, "long " * 100_000 + "x")]


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_groups(spark, bits):
    """With few bits, different chunks of one size share a hash and are told apart as texts."""
    rows = [x for x in texts() if bits == 64 or x[0] is None or x[0] < 4000]
    docs = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, recipe string, row int").repartition(5)
    assert found(exact_groups(docs, ChunkParams(least=4, most=40, hash_bits=bits))) == expected(rows)


def test_order_of_chunks_matters(spark):
    one, two = "aans ddes ", "bens aais "
    rows = [(1, one + two), (2, two + one), (3, one + two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(exact_groups(docs, SMALL)) == expected(rows)


def test_no_broadcast_and_empty(spark):
    rows = texts()[:200]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(exact_groups(docs, ChunkParams(broadcast_keys=0))) == expected(rows)
    assert exact_groups(docs.limit(0)).count() == 0


def test_chunks_follow_content(spark):
    """Chunks make up the text, keep their sizes, and an insertion changes few of them."""
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("aeinstdp") for _ in range(5)) for _ in range(20_000))
    p = ChunkParams()
    df = spark.createDataFrame([(0, text), (1, "new words " + text)], "k int, text string")
    cut = {r.k: r.c for r in df.select("k", chunks(df.text, p).alias("c")).collect()}
    assert "".join(cut[0]) == text and all(p.least <= len(c) <= p.most for c in cut[0][:-1])
    assert len(set(cut[1]) - set(cut[0])) <= 5 < len(cut[0])
