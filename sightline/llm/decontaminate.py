"""Operator 10: benchmark decontamination by a generalised suffix automaton.

The benchmark's words make one automaton. A benchmark of more than ``max_automaton_words`` or
``max_automaton_bytes`` makes several, built in tasks and kept in the shared folder: one at a time is sent,
the documents pass through it, and only the places they hit are written before the next one, so memory does
not grow with the benchmark and texts are written once at most. Documents stream through it word by word;
where the longest match reaches the window length, the words of the window are hit. For every state the
ancestor at the window length and the nearest one that ends a short item are known, so a word takes the same
work however often it repeats.

Defined cases: a null or wordless text has no words and no hits; null or wordless items match
nothing; what items without an id hit counts, but they are
listed nowhere; items with the same text are all reported; repeated rows are judged each for itself; empty
tables give empty results or no hits; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import materialize, release, table, trimmed

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z in lower case; every ASCII character that is no letter or digit becomes a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class DecontaminationParams:
    """A document is contaminated if hit words make up ``coverage`` of its words."""

    window: int = 13
    coverage: float = 0.05
    max_automaton_words: int = 200_000
    max_automaton_bytes: int = 2**25


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class SuffixAutomaton:
    """Suffixes of all items; each state knows the items whose window ends in it."""

    def __init__(self, items: Iterable[tuple[int, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.at_window = list(range(len(self.link)))
        for u in self.order:
            if self.length[self.link[u]] >= window:
                self.at_window[u] = self.at_window[self.link[u]]
        #: state -> items with a full window there; state -> (length, item) of whole short items
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, ids in coded:
            state = length = 0
            for i, c in enumerate(ids):
                state, length = self.step(state, length, c)
                if len(ids) >= window and i >= window - 1:
                    self.full.setdefault(self.at_window[state], set()).add(item)
            if len(ids) < window:
                self.short.setdefault(state, []).append((len(ids), item))
        self.short_at = self._nearest(self.short)
        self.least = min([window, *(len(ids) for _, ids in coded)])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        nxt = self.next
        while c not in nxt[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.length[state]
        return nxt[state][c], length + 1

    def _nearest(self, marked: dict) -> list[int]:
        """For each state itself or its nearest ancestor that is marked; 0 for none."""
        out = [0] * len(self.link)
        for u in self.order:
            out[u] = u if u in marked else out[self.link[u]]
        return out

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items with occurring windows."""
        n, w = len(words), self.window
        edges = np.zeros(n + 1, np.int64)
        found: set[int] = set()
        seen: set[int] = set()
        if n < self.least or not self.vocab:
            return edges[:n] > 0, found
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, n)
        # a match lies in a run of known words, so shorter runs hold none
        turns = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                state, length = self.step(state, length, c)
                if length >= w:
                    u = self.at_window[state]
                    if u not in seen:
                        seen.add(u)
                        found |= self.full.get(u, set())
                    edges[i - w + 1] += 1
                    edges[i + 1] -= 1
                if self.short:
                    u = self.short_at[state]
                    while u > 0:  # fewer than a window's words
                        k = self.short[u][0][0]  # a state ends short items of one length, as they are equal
                        if k <= length:
                            if u not in seen:
                                seen.add(u)
                                found.update(item for _, item in self.short[u])
                            edges[i - k + 1] += 1
                            edges[i + 1] -= 1
                        u = self.short_at[self.link[u]]
        return np.cumsum(edges[:n]) > 0, found - {None}


def automata(benchmark: DataFrame, p: DecontaminationParams) -> Iterator[bytes]:
    """Pickled automata of bounded size, built in tasks. Longer items are cut into parts that share all but one word
    of a window. They come to the driver one after another."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = max(p.max_automaton_words, p.window)
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = words_of(text)
                for k in range(0, max(1, len(words) - p.window + 1), most - p.window + 1):
                    if part := words[k : k + most]:
                        rows.append((item, b" ".join(part), len(part)))
            yield pd.DataFrame(rows, columns=["item", "part", "n"])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, n, size = [], 0, 0
        for batch in batches:
            out = []
            for item, part, words in batch.itertuples(index=False):
                if shard and (n + words > p.max_automaton_words or size + len(part) > p.max_automaton_bytes):
                    out.append(pickle.dumps(SuffixAutomaton(shard, p.window)))
                    shard, n, size = [], 0, 0
                shard.append((None if item is None else int(item), part.split()))
                n, size = n + words, size + len(part)
            yield pd.DataFrame({"data": out})
        if shard:
            yield pd.DataFrame({"data": [pickle.dumps(SuffixAutomaton(shard, p.window))]})

    # ids go as strings, as pandas turns long columns with nulls into floats
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    parts = materialize(items.mapInPandas(cut, "item string, part binary, n long"), "items")
    sums = parts.agg(F.sum("n").alias("n"), F.sum(F.octet_length("part")).alias("size")).first()
    if not sums["n"]:
        return
    shards = -(-sums["n"] // p.max_automaton_words) + sums["size"] // p.max_automaton_bytes
    built = materialize(parts.repartition(int(shards)).mapInPandas(build, "data binary"), "automata")
    release(parts)
    for r in built.toLocalIterator():
        yield bytes(r["data"])
    release(built)


_loaded: dict[bytes, SuffixAutomaton] = {}


def _automaton(data: bytes) -> SuffixAutomaton:
    """The automaton that this Python worker holds: one at a time."""
    key = hashlib.sha256(data).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = pickle.loads(data)
    return _loaded[key]


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


HITS = "n_words long, spans array<struct<a:long,b:long>>, items array<long>"


def _found(docs: DataFrame, data: bytes, kept: tuple[str, ...], all_rows: bool) -> DataFrame:
    """``kept`` columns of documents with their hits: n_words, spans, items; of all, or of those with hits."""
    held = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = _automaton(held.value)
        for batch in batches:
            rows = []
            for text, *rest in batch[["text", *(c for c in kept if c != "text")]].itertuples(index=False):
                words = words_of(text)
                hit, items = auto.hits(words)
                if all_rows or hit.any():
                    rows.append((*((text, *rest) if "text" in kept else rest), len(words), [{"a": a, "b": b} for a, b in runs(hit)], sorted(items)))
            order = [*(["text"] if "text" in kept else []), *(c for c in kept if c != "text"), "n_words", "spans", "items"]
            yield pd.DataFrame(rows, columns=order)[[*kept, "n_words", "spans", "items"]]

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys(("text", *kept))).mapInPandas(trimmed(run), ", ".join(f"{c} {kinds[c]}" for c in kept) + f", {HITS}")


def _merged(spans: pd.Series) -> pd.Series:
    """Sorted lists of spans without overlaps or touching ends."""

    def one(found) -> list[dict]:
        out: list[dict] = []
        for s in found if found is not None else ():
            if out and s["a"] <= out[-1]["b"]:
                out[-1]["b"] = max(out[-1]["b"], s["b"])
            else:
                out.append({"a": s["a"], "b": s["b"]})
        return out

    return spans.map(one)


def find_contamination(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams(), carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_words, spans (word positions, end excluded), items of each document, and its
    ``carried`` string columns."""
    shards = automata(benchmark, params)
    kept = ("doc_id", "text", *carried)
    first = next(shards, None) or pickle.dumps(SuffixAutomaton([], params.window))
    second = next(shards, None)
    columns = ("doc_id", "text", "n_words", "spans", "items", *carried)
    if second is None:
        return _found(docs, first, kept, True).select(*columns)
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("__row"), *kept), "texts")
    parts = [materialize(_found(rows, data, ("__row",), k == 0), "hits") for k, data in enumerate(chain([first, second], shards))]
    both = reduce(DataFrame.unionByName, parts).groupBy("__row").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    spans = F.pandas_udf(_merged, "array<struct<a:long,b:long>>")(F.col("spans"))
    return rows.join(both, "__row").withColumn("spans", spans).select(*columns)


def contaminated(n_hit, n_words, p: DecontaminationParams = DecontaminationParams()):
    return (n_hit > 0) & (n_hit >= p.coverage * n_words)


def n_hit_of(spans="spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])


def remove_spans(text: str, spans: list) -> str:
    """``text`` without the words of the spans and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(NORMAL))]
    out, last = [], 0
    for s in spans:
        out.append(raw[last : at[s["a"]][0]])
        last = at[s["b"] - 1][1]
    return b"".join([*out, raw[last:]]).decode(errors="replace")


def without_spans(text: str, spans: str) -> Column:
    """The column ``text`` without the words of the column ``spans``."""

    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None or not len(s) else remove_spans(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(text, spans)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("n_hit", n_hit_of())
    as_strings = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(as_strings, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
