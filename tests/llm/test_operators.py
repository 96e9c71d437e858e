"""The training-data operators against brute force, with nulls, empty, repeated and clashing input."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sightline.llm import decontaminate, induced, language_id, license_scan, line_dedup, near_duplicates, packing, quality, suffix_dedup, url_filter, warc_revisit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, h string, id string"


def corpus():
    """Texts with copies, near copies, a shared passage, nulls, empty and very long ones."""
    rng = random.Random(3)
    vocabulary = [f"w{k}é" for k in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = words(120), words(60)
    texts = [None, "", " ", "one", "two words", "a b c d", " ".join(words(3000)), "x" * 900, "ab" * 300]
    texts += [" ".join(base)] * 3
    for k in range(12):
        near = list(base)
        for _ in range(1 + k % 4):
            near[rng.randrange(len(near))] = f"new{k}"
        texts.append(" ".join(near))
    texts += [" ".join(words(20) + passage + words(20)) for _ in range(8)]
    texts += ["\n".join(["Boiler plate line.", " ".join(words(12)), "Boiler plate line."]) for _ in range(8)]
    return [(k, t, "en" if k % 2 else None, "s1" if k % 3 else None, 0, 1, "h", "id") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([*rows, rows[9]], SCHEMA)  # one row twice


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, empty):
    found = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for k, text, *_ in corpus():
        w = WORD.findall(text or "")
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = set()
        for i in range(len(w) - 2):
            if windows[tuple(w[i : i + 3])] > 1:
                hit |= {i, i + 1, i + 2}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = found[k]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert quality.quality_rules(empty).count() == 0


def test_quality_languages(spark):
    """A clean language far below any share of the documents is held against its own words."""
    rng = random.Random(5)

    def text(letters):
        vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(60)]
        return lambda: " ".join(rng.choice(vocabulary) for _ in range(400))

    latin, greek, russian = text("abcdefghijklmnopqrstuvwxyz"), text("αβγδεζηθικλμνξοπρστυφχψω"), text("абвгдежзиклмнопрст")
    rows = [(k, latin(), "en" if k % 9 else None) for k in range(3000)]
    rows += [(k, greek(), "el") for k in range(6000, 6021)]  # 0.7 % of the documents
    rows += [(7000, russian(), "ru"), (7001, latin(), "el")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    small, joined = quality.QualityParams(), quality.QualityParams(held_bytes=0)
    found = {r.doc_id: r for r in quality.quality_rules(docs, small).collect()}
    assert all(found[k].kept for k, _, _ in rows if k != 7001) and not found[7001].kept
    assert (found[7000].char_distance, found[7000].word_distance) == (None, None)
    assert found[6000].word_distance < 0.35 and found[0].char_distance is not None
    assert found == {r.doc_id: r for r in quality.quality_rules(docs, joined).collect()}
    for p in (small, joined):
        kept = quality.keep_quality(docs, p)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, r in found.items() if r.kept)


@pytest.mark.parametrize("shard", [1_500_000, 300])
def test_suffix_dedup(docs, empty, shard):
    p = suffix_dedup.RepeatParams(shard_bytes=shard, passes_bytes=700, chunk=1024)
    rows = suffix_dedup.remove_repeats(docs, p).collect()
    raws = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    count = Counter(b[i : i + 200] for _, b in raws for i in range(len(b) - 199))
    expected = Counter()
    for k, b in raws:
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                mark[i : i + 200] = True
        expected[k, bytes(x for x, m in zip(b, mark, strict=True) if not m)] += 1
    assert Counter((r.doc_id, bytes(r.kept)) for r in rows) == expected
    assert suffix_dedup.remove_repeats(empty, p).count() == 0


def test_induced_sorting():
    rng = random.Random(1)
    for _ in range(60):
        text = []
        for _ in range(rng.randint(1, 5)):
            text += [rng.randint(1, rng.choice([1, 2, 256])) for _ in range(rng.randint(0, 25))] + [0]
        t, depth = np.array(text), rng.choice([4, 50])
        at, lcp = induced.sorted_suffixes(t, depth, held=rng.choice([2, 1000]))
        suffix = {i: tuple(text[i : text.index(0, i)]) for i in range(len(text)) if text[i]}
        assert sorted(at.tolist()) == sorted(suffix)
        for k in range(1, len(at)):
            a, b = suffix[at[k - 1]][:depth], suffix[at[k]][:depth]
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert a <= b and lcp[k] == same


@pytest.mark.parametrize("params", [{"tile": 3, "leaf": 2, "held": 400, "run": 2}, {"tile": 9, "leaf": 3, "heavy": 20, "star_rounds": 0}, {}])
def test_near_duplicates(docs, empty, params):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs, near_duplicates.JaccardParams(**params)).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, text, *_ in corpus():
        w = WORD.findall((text or "").translate(low))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    assert found == {k: (len(s), top(k)) for k, s in sets.items()}
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_stages_without_ids(spark, tmp_path):
    """Null and repeated doc_ids: no link is lost, one row of each group stays, and contaminated rows go."""
    rng = random.Random(9)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    base, other, apart, passage = words(120), words(120), words(120), words(30)
    near = lambda w, k: " ".join([*w[:-k], *words(k)])
    big = 2**53 + 1
    rows = [(None, " ".join(base)), (4, " ".join(base)), (big, " ".join(base)), (5, near(base, 2)), (None, near(base, 3))]  # one group: 4 stays
    rows += [(7, " ".join(other)), (7, " ".join(apart)), (8, near(other, 1)), (9, near(apart, 1)), (7, " ".join(apart))]  # two groups with one id
    rows += [(None, "lonely " * 3), (None, "lonely " * 3), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = Counter((r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(docs).collect())
    assert found == Counter([(None, 4)] * 2 + [(4, 4), (big, 4), (5, 4)] + [(7, 7)] * 3 + [(8, 7), (9, 7)] + [(None, None)] * 4)
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.stage_near_duplicates(spark, docs, "").collect())
    assert left == Counter([rows[1], rows[5], rows[6], rows[10], rows[12], rows[13]])

    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = [(None, " ".join(passage + words(10))), (None, "a b"), (2, " ".join(passage)), (2, "c d"), (big, "e f"), (None, None), (3, " ".join([*words(600), *passage[:13]]))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in given], docs.schema).coalesce(1)
    left = Counter((r.doc_id, r.text, r.lang) for r in corpus_pipeline.stage_decontaminate(spark, docs, str(tmp_path)).collect())
    assert left == Counter([(i, t, "en") for i, t in (given[1], given[3], given[4], given[5])] + [(3, " ".join(given[6][1].split()[:600]) + " ", "en")])


def test_warc(spark):
    rows = [
        (1, "http://www.A.com/x/", 10, "response", "e1", None, None, {"date": "d1", "content-type": "t"}),
        (2, "https://a.com/x?utm_source=q#f", 20, "revisit", "e1", None, None, {"date": "d2", "content-type": "z"}),
        (3, "https://a.com/x", 30, "revisit", "e2", None, None, None),
        (4, "https://a.com/x", 10, "revisit", None, None, None, None),
        (5, None, 40, "revisit", None, None, None, None),
        (6, "https://a.com/x", None, "revisit", None, None, None, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    for spans in (1, 4096):
        found = {r.record_id: r for r in warc_revisit.resolve_revisits(records, spans).collect()}
        assert (found[2].response_id, found[2].headers) == (1, {"date": "d2", "content-type": "t"})
        assert {k: r.status for k, r in found.items()} == {2: "resolved", 3: "validator_mismatch", 4: "no_response", 5: "no_response", 6: "no_response"}
    assert warc_revisit.resolve_revisits(records.limit(0)).count() == 0


def test_warc_nulls(spark):
    rows = [
        (1, None, 10, "response"), (2, None, 20, "revisit"), (3, None, None, "response"), (4, None, None, "revisit"),
        (5, "http://a.com/x", None, "response"), (6, "http://a.com/x", None, "revisit"), (7, "http://a.com/x", 20, "revisit"),
        (8, "http://a.com/y", 10, "response"), (9, "http://a.com/y", None, "revisit"), (10, "http://a.com/y", 20, "revisit"),
    ]
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>"
    records = spark.createDataFrame([(*r, "e", None, None, None) for r in rows], schema)
    for spans in (1, 4096):
        found = {r.record_id: (r.status, r.response_id) for r in warc_revisit.resolve_revisits(records, spans).collect()}
        assert found == {k: ("no_response", None) for k in (2, 4, 6, 7, 9)} | {10: ("resolved", 8)}


def test_licenses(spark, empty):
    rows = [(1, "x\nLICENSED under  the apache license, version 2.0!\ny", "a"), (2, None, "a"), (3, "Released under the MIT License.", "b"), (4, "nothing here", "b")]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, size string")).collect()
    assert {(r.doc_id, r.line, r.license) for r in found if r.dice == 1} == {(1, 1, "Apache-2.0"), (3, 0, "MIT")}
    assert license_scan.scan_licenses(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    odd = ["  a  b ", "a\n b", "a \nb", "\n", "x's don't  ,,", "²² Ⅷ a² b.c,\n\nd e.\nf g\n", "a  b 　c", " lead", "trail ", "É,\nÉ"]
    for text in odd + [r[1] for r in corpus() if r[1]]:
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    rows = packing.pack(docs, path, 256).collect()
    by_sequence, total = defaultdict(list), 0
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        total += r.length
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert len(by_sequence) <= 1.2 * total / 256 + 1
    assert packing.pack(empty, path).count() == 0


def test_language(spark, empty):
    text = {"en": "the cat and this thing with those", "de": "der und nicht mit straße schön", "fr": "le chat est où ça été", "es": "el niño más corazón qué año"}
    rng = random.Random(5)
    rows = []
    for k in range(240):
        lang = rng.choice(sorted(text))
        rows.append((k, " ".join(rng.choice(text[lang].split()) for _ in range(30)), lang))
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    held = [k for k, _, _ in rows if found[k].held_out]
    assert held and np.mean([found[k].lang_pred == rows[k][2] for k in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())
    assert found[900].lang_pred == found[901].lang_pred == "und"
    assert language_id.identify(empty, language_id.learn(empty)).count() == 0
    again = docs.unionByName(docs)
    drawn = {(r.lang, r.text) for r in language_id.draw(again, 50).collect()}
    assert 40 < language_id.draw(again, 50).count() <= 50 and drawn <= {(lang, t) for _, t, lang in rows}
    assert drawn == {(r.lang, r.text) for r in language_id.draw(docs, 50).collect()}


def test_urls(spark):
    urls = ["http://M.b.com/en/1?x#y", "https://example.com/en/77", "x.com/en/", None, "http://a.example.net/de/81", "http://net/de", "https://spam.io/win/1", "http://com?/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.filter_urls(pages, [(frozenset({"host:spam.io"}), 0.9)]).collect()}
    assert [(r.rule, r.verdict) for _, r in sorted(rows.items())] == [("com/en/", "block"), ("example.com/en/7", "allow"), (None, "allow"), (None, "allow"), ("example.net/de/8", "block"), (None, "allow"), (None, "block"), (None, "allow")]
    assert (rows[0].host, rows[0].path, rows[7].host, rows[7].path) == ("m.b.com", "/en/1", "com", "")
    many = spark.createDataFrame([(k, f"https://{'bad' if k % 3 == 0 else 'good'}.org/a/{k}") for k in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    assert (frozenset({"host:bad.org"}), 1.0) in url_filter.mine_rules(many, labels)
    assert url_filter.mine_rules(many, labels.limit(0)) == []


def test_lines(docs, empty):
    rows = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, params=line_dedup.LineDedupParams(0.1, 2)).select("doc_id", "text", "n_dropped").collect()}
    lined = [k for k, t, *_ in corpus() if t and "Boiler" in t]
    for k in lined:
        assert rows[k].n_dropped == (2 if k % 3 else 0)
    assert rows[0].text is None and rows[1].text == ""
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_decontamination(spark, empty):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 13, 30])))) for k in range(40)] + [(99, None)]
    texts = [(k, " ".join(rng.choice(words) for _ in range(60)) + " " + (items[k % 40][1] or "").upper()) for k in range(40)] + [(50, None)]
    windows = defaultdict(set)
    for k, t in items:
        w = (t or "").split()
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(k)
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (2_000_000, 50):
        found = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench, decontaminate.DecontaminationParams(max_automaton_words=limit)).collect()}
        for k, t in texts:
            w, hit, seen = (t or "").lower().split(), set(), set()
            for window, owners in windows.items():
                for i in range(len(w) - len(window) + 1):
                    if tuple(w[i : i + len(window)]) == window:
                        hit |= set(range(i, i + len(window)))
                        seen |= owners
            assert sum(s.b - s.a for s in found[k].spans) == len(hit) and set(found[k]["items"]) == seen
    assert decontaminate.remove_spans("A b, c. d", [{"a": 1, "b": 3}]) == "A . d"
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
