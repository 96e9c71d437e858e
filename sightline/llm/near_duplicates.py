"""Operator 3: n-gram Jaccard join with count vectors in an R-tree.

Documents are sets of hashed 5-word shingles. Shingles fall into ``groups`` by hash, and a document
is the point of its counts per group; the overlap of two sets is at most the sum of their points'
coordinate minima, for single points and for the corner points of tree nodes alike.

1. Equal sets become one class.
2. Sets that reach the threshold share k shingles among the first n - ceil(t n) + k of any common
   order, with k = 1 + n / 20. Each set counts how many of its first shingles, in order of hash, occur
   in any other set; those that count fewer than k are linked with nothing (``shared_counts``). The
   same again for all shingles of the sets that are left, of which ceil(t n) must occur elsewhere.
3. The sets that are left take their first shingles again, those that many of them share last.
   In each group of sets with a common first shingle, every set is paired with a pivot of fitting
   size; pairs that survive the bound are verified, which joins most near copies at once.
4. The same with the set that shares most with others as the center of each group.
5. Where more than three sets of several components still share a first shingle, an R-tree over the points
   finds for each set the one of another component that its bound puts nearest. That pair is verified, which
   joins what links with many sets of a large component by one link of each.
6. In the groups that still hold several components, the tree finds all pairs whose bound suffices; those
   that come up in k groups are verified too. Long groups are cut into chunks, the tree's upper nodes:
   only chunks whose corners reach the bound meet.

No link between different sets is lost, and no group is expanded into all of its pairs.

Defined cases: fewer words than a shingle are one shingle; a null or wordless text is an empty set
and linked with nothing; equal texts are always linked; repeated rows give repeated results; a set is known by one of its rows,
so that null ids and ids of several texts lose no link, and a null id names a class or component only
if it has no other; an empty
table gives an empty result; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import materialize, release, table, trimmed
from sightline.llm.components import components
from sightline.llm.hashing import PartHashes, mix
from sightline.llm.shared_shingles import BLOB, SET, answered, place, records, sharing_rows

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_space = np.zeros(256, bool)
_space[list(b" \t\n\x0b\x0c\r")] = True
_place = np.random.default_rng(11).integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class JaccardParams:
    """``held`` bounds the hashes that a task sorts at once, ``heavy`` those whose frequencies are sent
    to all tasks (16 bytes each), ``tile`` the sets that meet in one tree, ``run`` the texts that are
    compared with one copy of another. Groups of at most ``pairs`` sets are paired without a tree."""

    words: int = 5
    percent: int = 75
    groups: int = 1024
    pairs: int = 3
    held: int = 2**19
    heavy: int = 2**20
    tile: int = 2000
    leaf: int = 32
    run: int = 256
    star_rounds: int = 2
    nearest_rounds: int = 1


#: Words of more bytes get a hash without algebraic structure: long words can cancel in a polynomial modulo 2^64
#: whatever its base, as the Thue-Morse words of 1,024 letters do.
LONG_WORD = 32


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    a = np.frombuffer(raw, np.uint8)
    gap = np.concatenate(([True], _space[a], [True]))
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    out = PartHashes(a).of(starts, ends)
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        digest = hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8, key=b"words").digest()
        out[k] = np.uint64(int.from_bytes(digest, "little"))
    return out


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text.encode().translate(LOWER))
    if not len(w):
        return w
    k = min(words, len(w))
    return np.unique(mix(sum(w[i : len(w) - k + 1 + i] * _place[i] for i in range(k)) + np.uint64(k)))


def common_prefix(n):
    """Least number of prefix shingles in common with a linked set of no fewer shingles."""
    return 1 + n // 20


def prefix_length(n: int, percent: int) -> int:
    return min(n, n + (-percent * n) // 100 + common_prefix(n))


def needed(a, b, percent: int):
    """Least overlap of sets of a and b shingles: 100 i >= percent (a + b - i)."""
    return -((-percent * (a + b)) // (100 + percent))


def _features(p: JaccardParams, buckets: int, heavy: np.ndarray, often: np.ndarray):
    """id, n, the first shingles (those that many sets share last), into how many parts the sets of each
    shingle are dealt, and the point of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                s = shingles(text, p.words)
                at = place(s, buckets)
                found = np.searchsorted(heavy, at).clip(max=max(0, len(heavy) - 1))
                rank = np.where(heavy[found] == at, often[found], 0) if len(heavy) else np.zeros(len(s), np.int64)
                order = np.lexsort((s, rank))[: prefix_length(len(s), p.percent)]
                salts = 1 + rank[order] // p.tile
                point = np.bincount((s >> np.uint64(40)).astype(np.int64) % p.groups, minlength=p.groups)
                rows.append((i, len(s), s[order].astype(np.int64), salts, packed(point)))
            yield pd.DataFrame(rows, columns=["id", "n", "prefix", "salts", "point"])

    return run


def heaviest(answers: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the hashes that most sets share, in order, with how many do; ``most`` at most: the
    least number of sets is raised until they fit."""
    pairs = answers.filter("flush = -1").select("data")

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(64, np.int64)
        for batch in batches:
            for raw in batch["data"]:
                total += np.bincount(np.log2(np.frombuffer(raw, np.uint64).reshape(2, -1)[1].astype(float)).astype(int), minlength=64)
        yield pd.DataFrame({"power": np.arange(64), "n": total})

    sizes = np.zeros(64, np.int64)
    for r in pairs.mapInPandas(histogram, "power int, n long").groupBy("power").agg(F.sum("n").alias("n")).collect():
        sizes[r["power"]] = r["n"]
    power = next(k for k in range(65) if sizes[k:].sum() <= most)
    bound = max(least, 2**power)

    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.frombuffer(raw, np.uint64).reshape(2, -1) for raw in batch["data"]]
            yield pd.DataFrame({"data": [x[:, x[1] >= bound].tobytes() for x in found]})

    parts = [np.frombuffer(r["data"], np.uint64).reshape(2, -1) for r in pairs.mapInPandas(frequent, "data binary").toLocalIterator()]  # most hashes at most
    at, often = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.uint64)
    order = np.argsort(at)
    return at[order], often[order].astype(np.int64)


def _pivots(percent: int):
    """Rows in order of (h, salt, n, id): those whose h may occur twice, each with the pivot of its run,
    the first set whose size still fits. Only the last row is held between batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = last = None  # the last row, not yet given out; (h, salt, pivot, its n)
        for batch in batches:
            h, salt, salts, n, ids = (batch[c].to_numpy() for c in ("h", "salt", "salts", "n", "id"))
            if held is not None:
                h, salt, salts, n, ids = (np.concatenate(([x], a)) for x, a in zip(held, (h, salt, salts, n, ids), strict=True))
            if not len(h):
                continue
            follows = (h[1:] == h[:-1]) & (salt[1:] == salt[:-1])
            same = np.concatenate(([last is not None and last[:2] == (h[0], salt[0])], follows))
            shared = same | np.concatenate((follows, [False])) | (salts > 1)
            out = []
            for k in np.flatnonzero(shared).tolist():
                if last is None or last[:2] != (h[k], salt[k]) or 100 * last[3] < percent * n[k]:
                    last = (h[k], salt[k], ids[k], n[k])
                out.append((h[k], ids[k], n[k], last[2]))
            # the last row of the batch comes again with the next one unless it was given out
            if shared[-1]:
                held = None
            else:
                held, last = (h[-1], salt[-1], salts[-1], n[-1], ids[-1]), None
            yield pd.DataFrame(out, columns=["h", "id", "n", "pivot"])

    return run


#: Counts are kept in half a byte; this one stands for itself and all above. Sums of full counts are OVER.
FULL, OVER = 15, 255
#: No set is larger.
NO_BOUND = 2**40


def bound(a: np.ndarray, b: np.ndarray, over: int = FULL) -> np.ndarray:
    """Summed coordinate minima, or no bound where both sides have full coordinates."""
    full = (a.max(-1) >= over) & (b.max(-1) >= over)
    return np.where(full, NO_BOUND, np.minimum(a, b).sum(-1, dtype=np.uint32).astype(np.int64))


def folded(points: np.ndarray, by: int = 4) -> np.ndarray:
    """The points of fewer, larger groups, which give a weaker bound."""
    parts = points.reshape(len(points), -1, by)
    return np.where(parts.max(axis=2) == FULL, OVER, parts.sum(axis=2, dtype=np.uint8)).astype(np.uint8)


def packed(point: np.ndarray) -> bytes:
    """Two counts in a byte."""
    p = np.minimum(point, FULL).astype(np.uint8)
    return (p[::2] | p[1::2] << 4).tobytes()


def unpacked(points, groups: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(points), np.uint8)
    out = np.empty((len(raw), 2), np.uint8)
    out[:, 0], out[:, 1] = raw & 15, raw >> 4
    return out.reshape(-1, groups)


def _survives(percent: int, groups: int):
    def run(a: pd.Series, na: pd.Series, b: pd.Series, nb: pd.Series) -> pd.Series:
        x, y = unpacked(a, groups), unpacked(b, groups)
        return pd.Series(bound(x, y) >= needed(na.to_numpy(), nb.to_numpy(), percent))

    return F.pandas_udf(run, "boolean")


class CountTree:
    """An R-tree of two levels over count vectors, packed in order of set size and leading counts.
    Corners and folded points are tested first."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int):
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.coarse = folded(self.points)
        self.starts = np.arange(0, len(sizes), leaf)
        self.corners = np.maximum.reduceat(self.coarse, self.starts)
        self.low = np.minimum.reduceat(self.sizes, self.starts)
        self.leaf = leaf

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Positions (as given) of the sets whose overlap bound reaches the threshold."""
        coarse = folded(point[None])[0]
        nodes = np.flatnonzero(bound(self.corners, coarse, OVER) >= needed(self.low, size, percent))
        at = (self.starts[nodes][:, None] + np.arange(self.leaf)).ravel()
        at = at[at < len(self.sizes)]
        for mine, own, over in ((self.coarse, coarse, OVER), (self.points, point, FULL)):
            at = at[bound(mine[at], own, over) >= needed(self.sizes[at], size, percent)]
        return self.order[at]


def closeness(a: np.ndarray, b: np.ndarray, na, nb) -> np.ndarray:
    """The greatest similarity that the bound allows."""
    common = np.minimum(bound(a, b), np.minimum(na, nb))
    return common / (na + nb - common)


def _tree_pairs(p: JaccardParams, nearest: bool = False):
    """Rows in order of tile and size: pairs of different components that may be linked, or only the
    ``nearest`` partner of each row of a tile. A tile of two chunks pairs across them, a tile of one
    chunk within it."""

    def tile(points: np.ndarray, sizes: np.ndarray, chunk: np.ndarray, comps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row positions of the pairs of a long run, by the tree. The rows of its largest component are
        found by the others."""
        tree = CountTree(points, sizes, p.leaf)
        across = len(set(chunk)) > 1
        names, counts = np.unique(comps, return_counts=True)
        largest = names[np.argmax(counts)]
        left, right = [], []
        for k in np.flatnonzero(comps != largest).tolist():
            found = tree.search(points[k], sizes[k], p.percent)
            found = found[((found < k) | (comps[found] == largest)) & (comps[found] != comps[k]) & ((chunk[found] != chunk[k]) | (not across))]
            if nearest and len(found):
                found = found[[np.argmax(closeness(points[found], points[k], sizes[found], sizes[k]))]]
            left.append(np.full(len(found), k))
            right.append(found)
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))

    def nearest_of(a: np.ndarray, b: np.ndarray, ids: np.ndarray, n: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        """The nearest one of the partners b of each row a."""
        parts = [closeness(points[a[k : k + p.tile]], points[b[k : k + p.tile]], n[a[k : k + p.tile]], n[b[k : k + p.tile]]) for k in range(0, len(a), p.tile)]
        score = np.concatenate([np.zeros(0), *parts])
        order = np.lexsort((ids[b], -score, a))
        order = order[np.diff(a[order], prepend=-1) > 0]
        return pa.RecordBatch.from_arrays([pa.array(ids[a[order]], pa.int64()), pa.array(ids[b[order]], pa.int64()), pa.array(score[order], pa.float64())], names=["a", "b", "score"])

    def pairs(g: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        """The pairs of whole runs, with how often each occurs."""
        *_, ids, n, comps, chunk, points = g
        points = unpacked([points.tobytes()], p.groups)
        coarse = folded(points)
        lengths = np.diff([*starts, len(ids)])
        run = np.repeat(np.arange(len(starts)), lengths)
        long = lengths > p.leaf
        left, right = [], []
        short = np.flatnonzero(~long[run])
        for d in range(1, p.leaf):  # rows of short runs against the d-th row before them
            x = short[short >= d]
            x = x[run[x] == run[x - d]]
            if not len(x):
                break
            x = x[(100 * n[x - d] >= p.percent * n[x]) & (comps[x] != comps[x - d])]
            for point, over in ((coarse, OVER), (points, FULL)):
                x = x[bound(point[x], point[x - d], over) >= needed(n[x], n[x - d], p.percent)]
            left.append(x)
            right.append(x - d)
        for k in np.flatnonzero(long).tolist():
            at = slice(starts[k], starts[k] + lengths[k])
            a, b = tile(points[at], n[at], chunk[at], comps[at])
            left.append(a + starts[k])
            right.append(b + starts[k])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (left, right))
        ok = comps[a] != comps[b]
        a, b = a[ok], b[ok]
        if nearest:
            return nearest_of(a, b, ids, n, points)
        out = pd.DataFrame({"a": np.maximum(ids[a], ids[b]), "b": np.minimum(ids[a], ids[b]), "k": common_prefix(np.minimum(n[a], n[b]))})
        return pa.RecordBatch.from_pandas(out.groupby(["a", "b", "k"], as_index=False).size().rename(columns={"size": "c"}), preserve_index=False)

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        """h, i, j, id, n, component, chunk, and the packed points as rows of bytes."""
        points = batch.column("point").cast(pa.large_binary())
        width = p.groups // 2
        begin = np.frombuffer(points.buffers()[1], np.int64)[points.offset]
        raw = np.frombuffer(points.buffers()[2], np.uint8, len(points) * width, begin).reshape(-1, width)
        return [*(batch.column(c).to_numpy() for c in ("h", "i", "j", "id", "n", "component", "chunk")), raw]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            rows = columns(batch)
            rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            other = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
            begins = np.concatenate(([0], 1 + np.flatnonzero(other)))
            rest = [x[begins[-1] :].copy() for x in rows]
            if len(begins) > 1:
                yield pairs([x[: begins[-1]] for x in rows], begins[:-1])
        if rest is not None:
            yield pairs(rest, np.zeros(1, np.int64))

    return run


def verify(pairs: DataFrame, texts: DataFrame, p: JaccardParams) -> DataFrame:
    """The linked ones of ``pairs`` (a, b). Texts travel to b's place, at most ``run`` to each copy
    of b's text, and are compared with it as they stream by."""
    counts = pairs.groupBy("b").agg(F.ceil(F.count("*") / p.run).alias("copies"))
    goes = pairs.join(counts, "b").select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), F.col("copies")).alias("salt"), F.lit(1).alias("kind"))
    stays = counts.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"))
    rows = goes.unionByName(stays).join(texts, "id").repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = own = None
        for batch in batches:
            out = []
            for i, b, salt, kind, text in batch[["id", "b", "salt", "kind", "text"]].itertuples(index=False):
                s = shingles(text, p.words)
                if kind == 0:
                    key, own = (b, salt), s
                elif key == (b, salt):
                    common = len(np.intersect1d(s, own, assume_unique=True))
                    if 100 * common >= p.percent * (len(s) + len(own) - common):
                        out.append((i, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return rows.mapInPandas(trimmed(run), "a long, b long")


def _open_rows(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows (h, id, n) of runs that hold several components, with these and the run's size."""
    known = rows.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_runs = known.groupBy("h").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("m")).filter("c0 < c1").select("h", "m")
    return materialize(known.join(open_runs, "h"), "open")


def _corners(groups: int):
    """The corner, the least size and (for a chunk of one component) the component of a chunk."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        points = unpacked(g["point"], groups)
        return pd.DataFrame({"h": g["h"].iloc[:1], "chunk": g["chunk"].iloc[:1], "owner": g["owner"].iloc[:1], "least": [g["n"].min()], "corner": [packed(points.max(axis=0))]})

    return run


def _tiles(rows: DataFrame, points: DataFrame, p: JaccardParams) -> DataFrame:
    """h, i, j, chunk, id, component of all open rows: a run of at most ``tile`` rows is one tile, of a
    longer one the pairs of chunks whose corners reach the bound. A chunk has rows of one large
    component, or of small ones, and chunks of one component never meet."""
    columns = ("h", "i", "j", "chunk", "id", "component")
    nothing = F.lit(0).cast("long")
    short = rows.filter(F.col("m") <= p.tile).withColumns({"i": nothing, "j": nothing, "chunk": nothing})
    long = rows.filter(F.col("m") > p.tile)
    sizes = long.groupBy("h", "component").agg(F.count("*").alias("c"))
    small = sizes.filter(F.col("c") <= p.tile // 4).groupBy("h").agg(F.ceil(F.sum("c") / p.tile).alias("groups"))
    large = F.col("c") > p.tile // 4
    chunk = F.when(large, F.xxhash64("component", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / p.tile)))).otherwise(F.xxhash64(F.lit(-1), F.pmod(F.xxhash64("component"), "groups")))
    placed = materialize(long.join(sizes, ["h", "component"]).join(small, "h", "left").select("h", "id", "component", chunk.alias("chunk"), F.when(large, F.col("component")).otherwise(F.lit(-1)).alias("owner")), "placed")
    corners = placed.join(points.select("id", "n", "point"), "id").groupBy("h", "chunk").applyInPandas(_corners(p.groups), "h long, chunk long, owner long, least long, corner binary")
    corners = materialize(corners, "corners")
    a, b = (corners.select("h", F.col("chunk").alias(x), F.col("owner").alias(f"o{x}"), F.col("least").alias(f"n{x}"), F.col("corner").alias(f"c{x}")) for x in "ij")
    meet = a.join(b, "h").filter("i <= j AND (oi <> oj OR oi = -1)").filter(_survives(p.percent, p.groups)("ci", "ni", "cj", "nj"))
    meet = materialize(meet.select("h", "i", "j"), "meet")
    left = placed.join(meet.withColumn("chunk", F.col("i")), ["h", "chunk"]).select(*columns)
    right = placed.join(meet.filter("i < j").withColumn("chunk", F.col("j")), ["h", "chunk"]).select(*columns)
    return short.select(*columns).unionByName(left).unionByName(right)


def text_key(text: str = "text"):
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text)


def linked_rows(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """For each row of ``docs``: doc_id, key (``text_key``), n, class_id, and ``first`` (doc_id, row,
    key) of the row that names its component; the last two are null for empty sets."""
    p = params
    docs = docs.select("doc_id", text_key().alias("key"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word takes some six bytes, so this many buckets have about ``held`` first hashes each
    at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(2**23, max(at_least, size // (16 * p.held)))
    cut = lambda text: shingles(text, p.words)
    first = lambda n: prefix_length(n, p.percent)

    # sets that share too few of their first shingles with any other go
    sent = materialize(docs.mapInArrow(trimmed(records(buckets, cut, first, p.held)), f"{SET}, {BLOB}"), "records")
    feats = materialize(sent.filter("row IS NOT NULL").drop("flush", "bucket", "data"), "sets")
    sharing = materialize(sharing_rows(sent.filter("row IS NULL"), answered(sent), lambda n: np.minimum(n, common_prefix(n))), "sharing")
    release(sent)
    sig = ["sig_a", "sig_b", "n"]
    sets = feats.filter("n > 0")
    classes = materialize(sets.groupBy(*sig).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "key")).alias("rep")).select(*sig, F.col("rep.row").alias("id"), "rep"), "classes")
    open_classes = sets.join(sharing, "row", "left_semi").select(*sig).distinct()
    named = classes.join(open_classes, sig, "left_semi").select("id", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.key").alias("key"))
    # the same text under the same doc_id stands for the set as well as its row does
    some = docs.join(named, "key").filter(F.col("doc_id").eqNullSafe(F.col("rep_doc"))).dropDuplicates(["key", "id"])
    some = materialize(some.select("id", "text"), "texts")

    # of all shingles of those that are left, enough for a link must occur elsewhere
    again = some.select(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("key"), "text")
    sent = materialize(again.mapInArrow(trimmed(records(buckets, cut, lambda n: n, p.held)), f"{SET}, {BLOB}"), "records")
    answers = materialize(answered(sent, p.leaf), "answers")
    sharing = sharing_rows(sent.filter("row IS NULL"), answers, lambda n: -(-p.percent * n // 100))
    ids = sent.filter("row IS NOT NULL").join(sharing, "row", "left_semi").select(F.col("key").alias("id"))
    texts = materialize(some.join(ids, "id", "left_semi"), "texts")
    release(sent, some)

    heavy, often = heaviest(answers, p.leaf, p.heavy)
    points = materialize(texts.mapInPandas(trimmed(_features(p, buckets, heavy, often)), "id long, n long, prefix array<long>, salts array<long>, point binary"), "points")
    release(answers)
    rows = points.select("id", "n", F.inline(F.arrays_zip(F.col("prefix").alias("h"), "salts"))).withColumn("salt", F.pmod(F.xxhash64("id"), "salts"))
    rows = rows.repartition("h", "salt").sortWithinPartitions("h", "salt", "n", "id")
    shared = materialize(rows.mapInPandas(trimmed(_pivots(p.percent)), "h long, id long, n long, pivot long"), "shared")

    def surviving(pairs: DataFrame) -> DataFrame:
        a, b = (points.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").filter(_survives(p.percent, p.groups)("pa", "na", "pb", "nb")).select("a", "b")

    first = shared.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    links = materialize(verify(materialize(surviving(first), "pairs"), texts, p), "links")
    joined = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    def with_links(found: DataFrame) -> DataFrame:
        """Components after further links: the stars so far stand for the links that made them."""
        stars = joined.select(F.col("node").alias("u"), F.col("component").alias("v"))
        return components(stars.unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    def around(rows: DataFrame) -> DataFrame:
        """Every set with the one of its run that shares most with others: the text that a group was
        copied from, as a rule."""
        weight = rows.groupBy("id").agg(F.sum("m").alias("weight"))
        heavy = rows.join(weight, "id").groupBy("h").agg(F.max_by(F.struct("id", "component"), F.struct("weight", "id")).alias("center"))
        pairs = rows.join(heavy, "h").filter("component <> center.component").select(F.col("id").alias("a"), F.col("center.id").alias("b")).distinct()
        return surviving(pairs)

    def in_tiles(rows: DataFrame) -> DataFrame:
        tiles = _tiles(rows.filter(F.col("m") > p.pairs), points, p)
        return tiles.join(points.select("id", "n", "point"), "id").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "id")

    def nearest(rows: DataFrame) -> DataFrame:
        found = in_tiles(rows).mapInArrow(trimmed(_tree_pairs(p, nearest=True)), "a long, b long, score double")
        return found.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("b"))

    # Each round leaves fewer runs that hold several components.
    rows = _open_rows(shared.select("h", "id", "n"), joined)
    release(shared)
    spent = None
    for partners in [around] * p.star_rounds + [nearest] * p.nearest_rounds:
        if partners is spent:
            continue  # the same pairs would come up again
        found = materialize(verify(materialize(partners(rows), "pairs"), texts, p), "links")
        if found.isEmpty():
            spent = partners
            continue
        joined = with_links(found)
        before, rows = rows, _open_rows(rows.select("h", "id", "n"), joined)
        release(before)
    few, placed = rows.filter(F.col("m") <= p.pairs), in_tiles(rows)
    one, other = (few.select("h", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}")) for x in "ab")
    close = (100 * F.least("na", "nb") >= p.percent * F.greatest("na", "nb")) & (F.col("ca") != F.col("cb"))
    paired = one.join(other, "h").filter(F.col("a") > F.col("b")).filter(close).select("a", "b", (1 + F.floor(F.least("na", "nb") / 20)).alias("k"), F.lit(1).cast("long").alias("c"))
    counted = placed.mapInArrow(trimmed(_tree_pairs(p)), "a long, b long, k long, c long").unionByName(paired).groupBy("a", "b").agg(F.max("k").alias("k"), F.sum("c").alias("c")).filter("c >= k").select("a", "b")
    more = materialize(verify(materialize(surviving(materialize(counted, "counted")), "pairs"), texts, p), "links")

    release(texts, points)
    final = (joined if more.isEmpty() else with_links(more)).withColumnRenamed("node", "id")
    placed = classes.join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = placed.groupBy("component").agg(F.min("rep").alias("first"))
    of_class = placed.join(named, "component").select(*sig, F.col("rep.doc_id").alias("class_id"), "first")
    return feats.select("doc_id", "key", *sig).join(of_class, sig, "left").select("doc_id", "key", "n", "class_id", "first")


def near_duplicates(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id."""
    return linked_rows(docs, params).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
