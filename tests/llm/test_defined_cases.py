"""Cases that the operators' docstrings define, each against brute force or by hand."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sightline.llm import decontaminate, license_scan, line_dedup, near_duplicates, packing, shared_shingles, suffix_dedup, url_filter, warc_revisit


def test_added_tokens():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    for text in ("<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y z", " <|endoftext|>\n<|endof", "<|endoftext|> <|endoftext|>"):
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_pieces_against_tokenizers(spark):
    """Every column of the packed pieces but the place, which must be gapless."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer, rng = Tokenizer.from_file(path), random.Random(4)
    texts = [None, "", "a", "one <|endoftext|> two", *(" ".join(f"w{rng.randrange(99)}" for _ in range(n)) for n in (5, 40, 41, 300, 900))]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, length string").repartition(3)
    expected = set()
    for k, t in enumerate(texts):
        ids = [*(tokenizer.encode(t, add_special_tokens=False).ids if t else []), 0]
        first = len(ids) % 128 or min(128, len(ids))
        starts = [0, *range(first, len(ids), 128)]
        for piece, (a, b) in enumerate(itertools.pairwise([*starts, len(ids)])):
            expected.add((k, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    rows = packing.pack(docs, path, 128).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    for _, group in itertools.groupby(sorted((r.sequence_id, r.offset, r.length) for r in rows), lambda x: x[0]):
        end = 0
        for _, offset, length in group:
            assert offset == end
            end += length
        assert end <= 128


def test_items_without_ids(spark):
    bench = spark.createDataFrame([(None, "a b c d e f g h i j k l m n"), (2, "a b c d e f g h i j k l m"), (1, "q r"), (10, "q r")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x A, b c d e f g h i j k l m n y", "s"), (2, "z q. r q r", "s"), (3, None, "s")], "doc_id long, text string, items string")
    for limit in (200_000, 13):
        found = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench, decontaminate.DecontaminationParams(max_automaton_words=limit)).collect()}
        assert [(s.a, s.b) for s in found[1].spans] == [(1, 15)] and found[1]["items"] == [2]
        assert [(s.a, s.b) for s in found[2].spans] == [(1, 5)] and found[2]["items"] == [1, 10]
        assert found[3].n_words == 0 and not found[3].spans


def test_decontamination_columns(spark, tmp_path):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    items = [(k, " ".join(words(rng.choice([3, 13, 20])))) for k in range(25)]
    texts = [(k, " ".join(words(200) + items[k % 25][1].split() * (k % 3))) for k in range(30)] + [(99, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in decontaminate.op10_decontaminate(spark, str(tmp_path)).collect():
        w, hit, seen = (dict(texts)[r.doc_id] or "").split(), set(), set()
        for item, text in items:
            of = text.split()
            for window in ({tuple(of[i : i + 13]) for i in range(len(of) - 12)} if len(of) >= 13 else {tuple(of)}):
                for i in range(len(w) - len(window) + 1):
                    if tuple(w[i : i + len(window)]) == window:
                        hit |= set(range(i, i + len(window)))
                        seen.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, seen))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(seen), digest, bool(hit) and 20 * len(hit) >= len(w))


def test_header_case(spark):
    rows = [
        (1, "http://a.com/x", 10, "response", None, None, "d", {"Date": "old", "Content-Type": "t"}, "q"),
        (2, "http://a.com/x", 10, "response", None, None, "d", {"Date": "tie"}, "q"),
        (3, "http://a.com/x", 20, "revisit", None, None, "d", {"date": "new", "content-type": "z"}, "q"),
        (4, "http://a.com/x", 20, "revisit", None, None, "other", None, "q"),
    ]
    records = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, response string")
    found = {r.record_id: r for r in warc_revisit.resolve_revisits(records).collect()}
    assert (found[3].response_id, found[3].headers, found[4].status) == (2, {"date": "new"}, "validator_mismatch")
    first = warc_revisit.resolve_revisits(records.filter("record_id <> 2")).filter("record_id = 3").first()
    assert first.headers == {"date": "new", "Content-Type": "t"}


def test_white_lines(spark):
    text = "\t\nkept\n \x0b\r\n\n"
    docs = spark.createDataFrame([(k, text, "s", "b") for k in range(8)], "doc_id long, text string, source string, __keys string").drop("__keys")
    rows = line_dedup.drop_boilerplate(docs, params=line_dedup.LineDedupParams(0.5, 2)).collect()
    assert {(r.text, r.n_lines, r.n_dropped) for r in rows} == {("\t\n \x0b\r\n\n", 5, 1)}


def test_licence_plan(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert "Exchange hashpartitioning(size" not in license_scan.scan_licenses(docs)._jdf.queryExecution().toString()


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(6)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice('ab')}.{rng.choice(['x', 'y'])}.org/{rng.choice(['p', 'q'])}/{k}" for k in range(400)]
    bad = [int(("a.x" in u and "/p/" in u) or rng.random() < 0.1) for u in urls]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, items string")
    labels = spark.createDataFrame([(k, 1, b) for k, b in enumerate(bad)] + [(0, None, None)], "doc_id long, quality int, toxic int")
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", url_filter.url_tokens(pages.url, url_filter.host_of(pages.url), url_filter.path_of(pages.url)).alias("t")).collect()}
    p, n, base = url_filter.MiningParams(), len(urls), sum(bad) / len(urls)
    both, of_bad = Counter(), Counter()
    for k, own in tokens.items():
        for size in range(1, len(own) + 1):
            for c in map(frozenset, itertools.combinations(sorted(own), size)):
                both[c] += 1
                of_bad[c] += bad[k]
    good = {}
    for c, m in both.items():
        confidence = of_bad[c] / m
        enough = of_bad[c] / n >= max(p.min_support, p.min_count / n) - 1e-12
        if enough and confidence >= p.min_confidence and confidence / base >= p.min_lift and (confidence - base) / (base * (1 - base) / m) ** 0.5 >= p.min_z:
            good[c] = confidence
    expected = {c: x for c, x in good.items() if not any(o < c and good[o] >= x for o in good)}
    found = dict(url_filter.mine_rules(pages, labels, p))
    assert found and found.keys() == expected.keys() and all(abs(found[c] - expected[c]) < 1e-9 for c in found)


def test_shared_counts():
    """Records, answers and sums count what occurs in other sets."""
    rng = np.random.default_rng(1)
    places = rng.integers(0, 50, 400).astype(np.uint64)
    owners = rng.integers(0, 30, 400)
    order, sent, several = shared_shingles.sent_records(places, owners)
    counts = Counter(places.tolist())
    assert sorted(several.tolist()) == sorted(o for p, o in zip(places.tolist(), owners.tolist(), strict=True) if counts[p] > 1)
    assert order.tolist() == sorted(counts) and [int(x) - shared_shingles.COUNTED for x in sent["owner"] if x >= shared_shingles.COUNTED] == [c for _, c in sorted(counts.items()) if c > 1]


def test_bounds():
    rng = np.random.default_rng(2)
    a, b = (rng.poisson(3, (40, 64)).clip(max=15).astype(np.uint8) for _ in "ab")
    a[:5, 3], b[:5, 9] = 15, 15
    fine = near_duplicates.bound(a, b)
    assert (fine[:5] == near_duplicates.NO_BOUND).all()
    coarse = near_duplicates.bound(near_duplicates.folded(a), near_duplicates.folded(b), near_duplicates.OVER)
    assert (fine >= np.minimum(a, b).sum(axis=1)).all() and (coarse >= np.where(fine == near_duplicates.NO_BOUND, 0, fine)).all()
    assert (near_duplicates.unpacked([near_duplicates.packed(x) for x in a], 64) == a).all()


@pytest.mark.parametrize("shard", [250, 900])
def test_spooled_groups(spark, shard):
    """Hot groups beyond the shard keep their last records, whatever group follows them."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = ["".join(rng.choice("xyz ") for _ in range(60)) + passage + "".join(rng.choice("xyz ") for _ in range(60)) for _ in range(12)]
    texts += ["".join(rng.choice("mnop") for _ in range(400))] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for r in suffix_dedup.remove_repeats(docs, suffix_dedup.RepeatParams(shard_bytes=shard, passes_bytes=500)).collect():
        t, mark = texts[r.doc_id], np.zeros(len(texts[r.doc_id]), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                mark[i : i + 200] = True
        assert bytes(r.kept).decode() == "".join(x for x, m in zip(t, mark, strict=True) if not m)


def test_words_that_cancel_in_polynomials(spark):
    """The Thue-Morse words of 1,024 letters differ, so their documents are not linked; equal ones are."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"{a} {a} {b} {a} {b} x"), (4, f"{b} {a} {b} {a} {a} x"), (5, b), (6, "w " * 20 + a), (7, "w " * 20 + b)]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2, 6: 6, 7: 7}


def test_repeated_words_take_linear_work():
    import time

    n, began = 200_000, time.process_time()
    auto = decontaminate.SuffixAutomaton([(1, [b"a"] * n), (2, [b"a"] * 3), (3, [b"b", b"a"])], 13)
    hit, items = auto.hits([b"c"] + [b"a"] * n + [b"b"])
    assert hit.sum() == n and items == {1, 2} and time.process_time() - began < 20


def test_many_automata(spark):
    """One automaton or many, built in tasks: the same hits as brute force."""
    rng = random.Random(12)
    words = lambda n, m=30: [f"w{rng.randrange(m)}" for _ in range(n)]
    items = [(k, " ".join(words(rng.choice([2, 5, 13, 30])))) for k in range(40)] + [(40, None), (41, "...")]
    docs = [(k, " ".join(words(100) + items[k % 40][1].split() + words(20))) for k in range(30)] + [(99, None), (None, items[2][1])]
    expected = {}
    for d, text in docs:
        w, hit, seen = (text or "").split(), set(), set()
        for item, t in items:
            of = (t or "").replace(".", "").split()
            for window in {tuple(of[i : i + 13]) for i in range(max(1, len(of) - 12))} if of else ():
                for i in range(len(w) - len(window) + 1):
                    if tuple(w[i : i + len(window)]) == window:
                        hit |= set(range(i, i + len(window)))
                        seen.add(item)
        expected[d] = (len(w), len(hit), sorted(seen))
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    df = spark.createDataFrame([(*x, "row", 1) for x in docs], "doc_id long, text string, row string, n_words int").repartition(4)
    for limit, size in ((200_000, 2**25), (60, 2**25), (200_000, 150)):
        found = decontaminate.find_contamination(df, bench, decontaminate.DecontaminationParams(max_automaton_words=limit, max_automaton_bytes=size), carried=("row",))
        assert {r.doc_id: (r.n_words, sum(s.b - s.a for s in r.spans), sorted(r["items"])) for r in found.collect()} == expected
