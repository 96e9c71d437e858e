"""Operator 2: removal of repeated byte strings by suffix arrays of shards.

A string of ``length`` bytes that occurs twice holds the same least k-gram hash both times. Each text
is cut into segments of windows with one least hash; segments whose hash occurs once in the corpus
cannot hold a repeat and go no further. Equal segments are repeats as a whole. The others are dealt
to shards by their hash, external induced sorting (``induced.py``) gives each shard's suffix array
with common prefixes, and neighbours that agree in ``length`` bytes are repeats.

Groups of one hash beyond ``shard_bytes`` are spooled to a local file and counted window by window,
in passes over ranges of window hashes, so memory is bounded for them too.

Defined cases: a null text is empty; shorter texts than ``length`` lose nothing; equal texts are
compared once and lose everything; repeated rows are equal texts; an empty table gives an empty
result; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import materialize, release, table
from sightline.llm.hashing import PartHashes
from sightline.llm.induced import sorted_suffixes


@dataclass(frozen=True)
class RepeatParams:
    """``chunk`` bounds the windows that are hashed at once, ``shard_bytes`` those sorted at once."""

    length: int = 200
    gram: int = 64
    chunk: int = 2**18
    shard_bytes: int = 1_500_000
    passes_bytes: int = 8_000_000


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima of blocks in both directions."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(raw: np.ndarray, p: RepeatParams) -> tuple[np.ndarray, ...]:
    """hash, content hash, start, length, and whether the segment may repeat within itself."""
    w = p.length - p.gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, len(raw) - p.length + 1, p.chunk):
        part = raw[begin : begin + p.chunk + p.length - 1]
        hashes = PartHashes(part)
        grams = hashes.windows(p.gram)
        least = sliding_min(grams, w)
        starts = np.concatenate(([0], 1 + np.flatnonzero(least[1:] != least[:-1])))
        ends = np.concatenate((starts[1:], [len(least)])) + p.length - 1
        h = least[starts]
        counts = ends - starts - p.gram + 1  # the grams of each segment
        begins = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) + np.repeat(starts - begins, counts)
        own = np.add.reduceat(grams[at] == np.repeat(h, counts), begins, dtype=np.int64) > 1
        found.append((h.astype(np.int64), (hashes.of(starts, ends) + (ends - starts).astype(np.uint64)).astype(np.int64), starts + begin, ends - starts, own))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else ()


def _segment_rows(p: RepeatParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = segments(np.frombuffer((text or "").encode(), np.uint8), p)
                if rows:
                    ids.append(np.full(len(rows[0]), i))
                    found.append(rows)
            if found:
                h, sh, s, length, own = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, sh, np.concatenate(ids), s, length, own)], ["h", "sh", "id", "s", "len", "own"])

    return run


def _shared_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (h, sh): those whose h occurs again or that may repeat within themselves,
    with whether equal content occurs again and whether the row is its content's first."""
    rest = before = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        rest = batch.iloc[-1:]
        if len(batch) > 1:
            yield _flag(batch, before, True)
            last = batch.iloc[-2]
            before = (last["h"], last["sh"])
    if rest is not None:
        yield _flag(rest, before, False)


def _flag(batch: pd.DataFrame, before, more: bool) -> pd.DataFrame:
    h, sh = batch["h"].to_numpy(), batch["sh"].to_numpy()
    same_h = np.concatenate(([before is not None and before[0] == h[0]], h[1:] == h[:-1]))
    same = same_h & np.concatenate(([before is not None and before[1] == sh[0]], sh[1:] == sh[:-1]))
    out = batch.assign(shared=same_h | np.append(same_h[1:], False), dup=same | np.append(same[1:], False), first=~same)
    out = out.iloc[:-1] if more else out
    return out[out["shared"] | out["own"]]


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
            raw = text.encode()
            rows += [(x["h"], x["sh"], raw[x["s"] : x["s"] + x["len"]]) for x in wanted]
        yield pd.DataFrame(rows, columns=["h", "sh", "bytes"])


def intervals(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by windows at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def sorted_repeats(parts: list[bytes], p: RepeatParams) -> list[list[tuple[int, int]]]:
    """For each segment of a shard the runs covered by strings that occur again in the shard."""
    raw = b"\0".join(parts) + b"\0"
    text = np.frombuffer(raw, np.uint8).astype(np.int64) + 1
    bounds = np.cumsum([len(x) + 1 for x in parts])
    text[bounds - 1] = 0
    at, lcp = sorted_suffixes(text, p.length)
    twice = lcp >= p.length
    hit = np.zeros(len(text), bool)
    hit[at[twice | np.append(twice[1:], False)]] = True
    return [intervals(np.flatnonzero(hit[b - len(x) - 1 : b]), p.length) for x, b in zip(parts, bounds.tolist(), strict=True)]


def counted_repeats(spool, n: int, size: int, p: RepeatParams) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """The same for a group in a file of (length, bytes) records: windows are counted by hash, a
    range of hashes at a time. Yields record numbers with their runs, in several turns."""
    passes = -(-size // p.passes_bytes)

    def windows(k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        spool.seek(0)
        for record in range(n):
            raw = np.frombuffer(spool.read(int.from_bytes(spool.read(8), "little")), np.uint8)
            at = np.arange(len(raw) - p.length + 1)
            v = PartHashes(raw).windows(p.length)
            mine = v % np.uint64(passes) == k
            yield record, at[mine], v[mine]

    for k in range(passes):
        every = np.sort(np.concatenate([v for _, _, v in windows(k)]))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        for record, at, v in windows(k):
            if found := intervals(at[np.isin(v, again)], p.length):
                yield record, found


def _shard_repeats(p: RepeatParams):
    def rows(keys: list[tuple[int, int]], found: list[list[tuple[int, int]]]) -> pd.DataFrame:
        return pd.DataFrame([(h, sh, a, b) for (h, sh), runs in zip(keys, found, strict=True) for a, b in runs], columns=["h", "sh", "a", "b"], dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, parts, size = [], [], 0  # whole groups
        group, group_keys, held, spool, spooled, now = [], [], 0, None, 0, None

        def to_file() -> None:
            nonlocal group, held, spool, spooled
            spool = spool or tempfile.TemporaryFile()
            for x in group:
                spool.write(len(x).to_bytes(8, "little") + x)
            group, spooled, held = [], spooled + held, 0

        def close() -> Iterator[pd.DataFrame]:
            """End a group: a spooled one is counted, another one joins the shard."""
            nonlocal keys, parts, size, group, group_keys, held, spool, spooled
            if spool is not None:
                to_file()
                for record, runs in counted_repeats(spool, len(group_keys), spooled, p):
                    yield rows([group_keys[record]], [runs])
                spool.close()
            else:
                if size + held > p.shard_bytes and parts:
                    yield rows(keys, sorted_repeats(parts, p))
                    keys, parts, size = [], [], 0
                keys, parts, size = keys + group_keys, parts + group, size + held
            group, group_keys, held, spool, spooled = [], [], 0, None, 0

        for batch in batches:
            for h, sh, raw in batch.itertuples(index=False):
                if h != now:
                    yield from close()
                    now = h
                group_keys.append((h, sh))
                group.append(raw)
                held += len(raw)
                if held > p.shard_bytes:
                    to_file()
        yield from close()
        if parts:
            yield rows(keys, sorted_repeats(parts, p))

    return run


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(p: RepeatParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, copies, found in batch[["doc_id", "text", "copies", "runs"]].itertuples(index=False):
                raw = (text or "").encode()
                if copies > 1 and len(raw) >= p.length:
                    runs = [(0, len(raw))]
                else:
                    runs = merged([(x["a"], x["b"]) for x in found]) if found is not None else []
                ends = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((doc_id, len(raw), [{"a": a, "b": b} for a, b in runs], kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])

    return run


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with a 64-bit id of their text, and (id, copies, rep); the seed of the id is the
    first under which no two different texts of the corpus, by a second hash and length, meet."""
    text = F.coalesce("text", F.lit(""))
    seed = 0
    while True:
        with_id = docs.select("doc_id", text.alias("text")).withColumn("id", F.xxhash64("text", F.lit(seed)))
        other = F.struct(F.xxhash64("text", F.lit(-1)), F.length("text"))
        classes = with_id.groupBy("id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.min(other).alias("x"), F.max(other).alias("y"))
        classes = materialize(classes.select("id", "copies", "rep", (F.col("x") != F.col("y")).alias("mixed")), "classes")
        if not classes.filter("mixed").limit(1).count():
            return with_id, classes.drop("mixed")
        seed += 1


def remove_repeats(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes), kept (the other bytes) of each document."""
    p = params
    docs, classes = identified(docs)
    multiple = materialize(classes.filter("copies > 1"), "multiple")
    gone = materialize(docs.select("doc_id", "id").join(multiple, "id").filter("doc_id > rep").select("doc_id", "id").distinct(), "copies")
    single = docs.join(gone, ["doc_id", "id"], "left_anti")

    rows = single.filter(F.octet_length("text") >= p.length).select("id", "text").mapInArrow(_segment_rows(p), "h long, sh long, id long, s long, len long, own boolean")
    ordered = rows.repartition("h").sortWithinPartitions("h", "sh")
    schema = "h long, sh long, id long, s long, len long, own boolean, shared boolean, dup boolean, first boolean"
    shared = materialize(ordered.mapInPandas(_shared_rows, schema), "shared")

    mixed = shared.groupBy("h").agg(F.min("sh").alias("x"), F.max("sh").alias("y")).filter("x < y").select("h")
    first = shared.filter("first")
    wanted = materialize(first.join(mixed, "h", "left_semi").unionByName(first.filter("own").join(mixed, "h", "left_anti")).select("id", F.struct("h", "sh", "s", "len").alias("want")), "wanted")
    size = wanted.agg(F.sum("want.len")).first()[0] or 0
    lists = wanted.groupBy("id").agg(F.collect_list("want").alias("wanted"))
    # rows that repeat a document give its segments twice
    parts = single.select("id", "text").join(lists, "id").select("text", "wanted").mapInPandas(_slices, "h long, sh long, bytes binary").dropDuplicates(["h", "sh"])
    shards = parts.repartition(max(1, -(-size // (4 * p.shard_bytes))), "h").sortWithinPartitions("h")
    repeats = materialize(shards.mapInPandas(_shard_repeats(p), "h long, sh long, a long, b long"), "repeats")
    release(wanted)

    whole = shared.filter("dup").select("id", F.col("s").alias("a"), (F.col("s") + F.col("len")).alias("b"))
    within = shared.filter("NOT dup").join(repeats, ["h", "sh"]).select("id", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b"))
    runs = materialize(whole.unionByName(within).groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("runs")), "runs")
    release(shared, repeats)
    # what stands in neither list is unique as a whole; both are small next to the texts as a rule
    marks = materialize(runs.join(multiple.select("id", "copies"), "id", "full").select("id", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "runs"), "marks")
    marked = docs.join(marks, "id", "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "runs")
    return marked.mapInPandas(_cut(p), "doc_id long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
