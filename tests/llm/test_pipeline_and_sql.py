"""Stages of the pipeline one by one, and base columns of op1 and op8 against SQL."""

import random

import duckdb
import pytest

import corpus_pipeline
from sightline.llm import quality, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(rng):
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, f"Menu home about\n{line(80)}\n{line(60)}", "en", "site0", None) for k in range(60)]
    rows += [(100, None, "en", "site0", None), (101, "", "en", None, 0), (102, "a b a b a b " * 30, "en", "site1", None), (103, "too short", "en", "site1", None), (None, line(150), None, None, None)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(random.Random(4)), SCHEMA)


def test_quality_stage(spark, docs):
    kept = corpus_pipeline.stage_quality(spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(60)) | {None} <= ids and not ids & {100, 101, 102, 103}


def test_line_dedup_stage(spark, docs):
    cut = {r.doc_id: r for r in corpus_pipeline.stage_line_dedup(spark, docs, SF).collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert cut.keys() == before.keys() and list(cut[0].asDict()) == docs.columns
    for k, r in cut.items():
        text = before[k].text
        assert r.text == (text.split("\n", 1)[1] if k is not None and k < 60 else text)
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_pack_stage(spark, docs):
    rows = corpus_pipeline.stage_pack(spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


def test_base_columns_of_quality_against_sql(spark):
    word = r"[^\x20\x09-\x0D]+"
    found = duckdb.sql(rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM '{SF}/documents.parquet'),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, range(1, 100000) r(i) WHERE i <= len(w) - 2),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id)
SELECT d.doc_id, len(w), coalesce(list_sum(list_transform(w, lambda x: length(x))), 0), len(regexp_extract_all(text, '[#*$%&|<>]')), len(lines) - len(list_distinct(lines)), coalesce(n, 0), len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w)
FROM d LEFT JOIN hit USING (doc_id)""").fetchall()
    rows = quality.op1_quality_rules(spark, SF).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == sorted(tuple(r) for r in found)
    assert all(r.kept is False for r in rows if r.base_failed)


def test_listed_rules_against_sql(spark):
    found = duckdb.sql(f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS p FROM '{SF}/pages.parquet'),
s AS (SELECT page_id, CASE WHEN p > 0 THEN substring(url, p + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS v(verdict, rule_host, rule_path))
SELECT page_id, any_value(host), any_value(path), arg_max(rule_host || rule_path, length(rule_host || rule_path)), arg_max(verdict, length(rule_host || rule_path))
FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id""").fetchall()
    rows = {r.page_id: r for r in url_filter.op8_url_filter(spark, SF).collect()}
    assert len(rows) == len(found) and any(x[3] for x in found)
    for page_id, host, path, rule, verdict in found:
        r = rows[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
