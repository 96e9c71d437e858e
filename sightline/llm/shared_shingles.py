"""How many shingles of each set occur in other sets, by one shuffle of packed hashes.

Tasks sort the hashes of the sets that they hold. What occurs once there goes to the hash's bucket as
a record of 9 bytes, what occurs several times as one record with its count, so a shingle that a third
of all sets share arrives once for each ``held`` hashes at most. Buckets answer which records were
shared, and the answers are summed for each run of sets.

Hashes are told apart by bucket and 40 bits; two that agree in these make a count larger, never smaller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.hashing import BASE, mix

ITEM = np.dtype([("low", "u1", 5), ("owner", "<u4")])
#: Owners from here on are no owners but counts of sets.
COUNTED = 2**31
#: Buckets of what a task answers itself, and of the sizes of its sets.
LOCAL, SIZES = -1, -2
#: What a record says of its set, besides its hashes: nothing else of the text leaves the task.
SET = "row long, doc_id long, key long, n long, sig_a long, sig_b long"
BLOB = "flush long, bucket int, data binary"


def place(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 40 further bits of each hash, as one number in the order of the buckets."""
    h = mix(hashes ^ BASE)
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)) << np.uint64(40) | h & np.uint64(2**40 - 1)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s + BASE).sum(dtype=np.uint64).astype(np.int64))


def pack_records(places: np.ndarray, owners: np.ndarray) -> np.ndarray:
    out = np.empty(len(places), ITEM)
    out["low"] = places.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out["owner"] = owners
    return out


def sent_records(places: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order, their records, and the owners of what occurs several times here."""
    order = np.argsort(places, kind="stable")
    places, owners = places[order], owners[order]
    begins = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
    counts = np.diff(np.append(begins, len(places)))
    several = counts > 1
    first = np.where(several, COUNTED + np.minimum(counts, COUNTED - 1), owners[begins])
    return places[begins], pack_records(places[begins], first), owners[np.repeat(several, counts)]


def records(buckets: int, shingles: Callable[[str], np.ndarray], first: Callable[[int], int], held: int):
    """(doc_id, key, text) -> a row for each set, and rows (flush, bucket, data) of its first hashes.
    Equal sets of one flush send their hashes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        sets: list[tuple] = []
        hashes: list[np.ndarray] = []
        seen: set[tuple] = set()
        size, flush = 0, row

        def out() -> pa.RecordBatch:
            nonlocal sets, hashes, size, flush
            blobs = []
            if size:
                owners = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
                places, sent, own = sent_records(place(np.concatenate(hashes), buckets), owners)
                of = (places >> np.uint64(40)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                blobs = [(flush, int(of[a]), sent[a:b].tobytes()) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=True)]
                blobs += [(flush, LOCAL, own.astype("<u4").tobytes()), (flush, SIZES, np.array([x[3] for x in sets], "<u4").tobytes())]
            columns = list(zip(*(s + (None,) * 3 for s in sets), *((None,) * 6 + b for b in blobs), strict=True)) or [[]] * 9
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
            names = [x.split()[0] for x in f"{SET}, {BLOB}".split(", ")]
            found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
            sets, hashes, size, flush = [], [], 0, row
            seen.clear()
            return found

        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                s = shingles(text)
                of = (len(s), *signature(s))
                sets.append((row, doc_id, key, *of))
                hashes.append(s[: first(len(s))] if len(s) and of not in seen else s[:0])
                seen.add(of)
                size += len(hashes[-1])
                row += 1
                if size >= held or len(sets) >= held // 32:
                    yield out()
        yield out()

    return run


def _answers(heavy: int):
    """The records of one bucket: whose are shared, for each flush; and the hashes that ``heavy`` sets
    or more share, with their number (flush -1)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        lengths = g["data"].str.len().to_numpy() // ITEM.itemsize
        items = np.frombuffer(b"".join(g["data"]), ITEM)
        low = np.zeros((len(items), 8), np.uint8)
        low[:, :5] = items["low"]
        low = low.view("<u8").ravel()
        order = np.argsort(low, kind="stable")
        begins = np.flatnonzero(np.diff(low[order], prepend=np.uint64(2**63)))
        counts = np.diff(np.append(begins, len(order)))
        owner = items["owner"].astype(np.int64)
        hit = np.zeros(len(items), bool)
        hit[order] = np.repeat(counts > 1, counts)
        hit &= owner < COUNTED
        of = np.repeat(np.arange(len(g)), lengths)[hit]
        ends = np.searchsorted(of, np.arange(len(g) + 1))
        answers = owner[hit].astype("<u4")
        flushes = g["flush"].tolist()
        rows = [(flushes[k], answers[ends[k] : ends[k + 1]].tobytes()) for k in range(len(g)) if ends[k] < ends[k + 1]]
        if heavy:
            total = np.add.reduceat(np.where(owner < COUNTED, 1, owner - COUNTED)[order], begins)
            often = total >= heavy
            if often.any():
                at = (np.uint64(g["bucket"].iloc[0]) << np.uint64(40)) | low[order][begins[often]]
                rows.append((-1, np.stack([at, total[often].astype(np.uint64)]).tobytes()))
        return pd.DataFrame(rows, columns=["flush", "data"])

    return run


def _kept(least: Callable[[np.ndarray], np.ndarray]):
    """The answers of one flush: the rows that share enough."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        sizes = np.frombuffer(g["data"][g["sizes"]].iloc[0], "<u4").astype(np.int64)
        hits = np.bincount(np.frombuffer(b"".join(g["data"][~g["sizes"]]), "<u4"), minlength=len(sizes))
        return pd.DataFrame({"row": g["flush"].iloc[0] + np.flatnonzero((sizes > 0) & (hits >= least(sizes)))})

    return run


def answered(blobs: DataFrame, heavy: int = 0) -> DataFrame:
    """(flush, data): the shared records of each flush, and the heavy hashes under flush -1."""
    sent = blobs.filter("bucket >= 0")
    return sent.select("flush", "bucket", "data").groupBy("bucket").applyInPandas(_answers(heavy), "flush long, data binary")


def sharing_rows(blobs: DataFrame, answers: DataFrame, least: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of which ``least(n)`` hashes or more occur in other sets as well."""
    own = blobs.filter("bucket < 0").select("flush", "data", (F.col("bucket") == SIZES).alias("sizes"))
    both = own.unionByName(answers.filter("flush >= 0").select("flush", "data", F.lit(False).alias("sizes")))
    return both.groupBy("flush").applyInPandas(_kept(least), "row long")
