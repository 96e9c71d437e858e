"""Operator 6: best-fit packing from a length histogram.

Texts become token ids, long documents are cut, and the histogram of piece lengths (at most
``size`` rows) is packed best-fit in decreasing length: whole classes of equal pieces go into classes
of equally full sequences, so the plan's work does not depend on the number of documents. Pieces
then take the planned slots by their rank within their length.

Defined cases: a null text is empty, and an empty document is the end id alone; repeated rows are
packed each for itself; equal lengths take slots in any order; an empty table gives an empty result;
other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.common import materialize, table, trimmed

SIZE, END_ID = 2048, 0
#: Encodings of words kept by a Python worker; longer words are not kept.
KEPT_WORDS, KEPT_CHARS = 150_000, 64


def byte_of_symbol() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: visible Latin-1
    characters are themselves, the other bytes follow from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordEncoder:
    """Token ids of a text as little-endian 32-bit numbers, as ``tokenizers`` gives them for the file.

    The tokenizer never joins what stands on both sides of a single space between other
    characters, so such parts are encoded once each and kept. What is full becomes the older
    generation, from which words come back as they occur, so frequent words stay. New words go
    through the same vocabulary as byte ranks, which is several times faster for them."""

    def __init__(self, tokenizer_path: str):
        import public_tokenizers
        import tiktoken

        with open(tokenizer_path, encoding="utf-8") as f:
            given = json.load(f)
        vocabulary, byte = given["model"]["vocab"], byte_of_symbol()
        #: Tokens that stand for themselves wherever they occur in a text, longest first.
        self.added = {x["content"]: array("I", [x["id"]]).tobytes() for x in given["added_tokens"]}
        self.apart = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token) and token not in self.added}
        self.ids = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drops the kept words: the next task's are others, and the worker serves other stages meanwhile."""
        self.kept, self.older = {}, {}

    def _encode(self, part: str) -> bytes:
        return array("I", self.ids(part)).tobytes()

    def encode(self, text: str) -> bytes:
        if self.apart is None or not self.apart.search(text):
            return self._plain(text)
        out, last = [], 0
        for m in self.apart.finditer(text):
            out += [self._plain(text[last : m.start()]), self.added[m[0]]]
            last = m.end()
        return b"".join([*out, self._plain(text[last:])])

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        first, *parts = text.split(" ")
        if not parts or not first or first[-1].isspace():
            return self._encode(text)
        ids = list(map(self.kept.get, parts))
        if None in ids:
            missing = {w for w, x in zip(parts, ids, strict=True) if x is None}
            if any(w != w.strip() or not w for w in missing):
                return self._encode(text)
            new = {w: self.older.get(w) or self._encode(" " + w) for w in missing}
            ids = [new[w] if x is None else x for w, x in zip(parts, ids, strict=True)]
            self.kept.update((w, x) for w, x in new.items() if len(w) <= KEPT_CHARS)
            if len(self.kept) > KEPT_WORDS:
                self.kept, self.older = {}, self.kept
        return self._encode(first) + b"".join(ids)


_encoders: dict[str, WordEncoder] = {}


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than ``size``."""
    first = n % size or size
    return [(0, min(first, n)), *((s, size) for s in range(first, n, size))]


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """For each length the slots: first rank, first sequence and offset of each range of ranks; and
    the number of sequences. A range goes on to the next range's first rank, sequence by sequence."""
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free ids -> ranges of sequences (first, how many)
    free: list[int] = []  # the keys of room, in order
    sequences = 0

    def put_back(left: int, first: int, n: int) -> None:
        if n and left:
            if not room[left]:
                bisect.insort(free, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                left = free[at]
                first, n = room[left].pop()
                if not room[left]:
                    free.pop(at)
            else:
                left, first = size, sequences
                n = -(-todo // (size // length))
                sequences += n
            each = left // length
            full = min(n, todo // each)
            parts = [(first, full, each)]
            if full < n and todo > full * each:
                parts.append((first + full, 1, todo - full * each))
            for start, many, times in parts:
                for k in range(times if many else 0):
                    slots[length].append((rank, start, size - left + k * length))
                    rank += many
                todo -= many * times
                put_back(left - times * length, start, many)
            used = sum(many for _, many, _ in parts)
            put_back(left, first + used, n - used)
    return {length: tuple(np.array(x, np.int64) for x in zip(*s, strict=True)) for length, s in slots.items()}, sequences


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """The pieces of every document, each with its rank among the part's pieces of its length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, WordEncoder(tokenizer_path))
        part, ranks = TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (encoder.encode(text) if text else b"") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, ranks[length]))
                    ranks[length] += 1
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])
        encoder.forget()

    return docs.select("doc_id", "text").mapInPandas(trimmed(run), PIECES)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    found = materialize(pieces(docs, tokenizer_path, size), "pieces")
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    slots, _ = plan({r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}, size)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = (b.pop("rank") + b.pop("before")).to_numpy()
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for length, where in b.groupby("length").indices.items():
                ranks, first, offsets = slots[length]
                at = np.searchsorted(ranks, rank[where], "right") - 1
                sequence[where], offset[where] = first[at] + rank[where] - ranks[at], offsets[at]
            yield b.assign(sequence_id=sequence, offset=offset)

    ranked = found.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before")
    return ranked.mapInPandas(trimmed(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
