"""External induced sorting of the suffixes of a shard, with common-prefix lengths.

The shard is a sequence of segments; a suffix ends with its segment. Suffixes that are smaller than
their successor and follow a larger one (the sample) are sorted first: the strings between them get
names in their order, and the sequence of names is sorted in turn. All others are induced from them.
Each bucket, the suffixes of one first byte, has a
queue of (position, common prefix with the entry before it); sorted entries are taken out bucket by
bucket and put their predecessors into the queues in order. A queue keeps ``held`` entries in memory
and the rest in a file of the task, which goes with it.

Common prefixes are carried along: two entries that enter a queue one after the other share one byte
more than the least common prefix of what was taken out between their successors. Lengths are cut
at ``depth``; suffixes that agree up to there may come in any order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

END = 0  # ends a segment; bytes are 1 to 256


class BucketQueue:
    """Entries of one bucket in the order of their arrival, beyond ``held`` in a file."""

    def __init__(self, held: int):
        self.held, self.parts, self.n, self.file = held, [], 0, None

    def put(self, at: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.append((at, lcp))
        self.n += len(at)
        if self.n > self.held:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            for a, b in self.parts:
                np.save(self.file, a)
                np.save(self.file, b)
            self.parts, self.n = [], 0

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.file is not None:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield np.load(self.file), np.load(self.file)
            self.file.close()
            self.file = None
        parts, self.parts, self.n = self.parts, [], 0
        yield from parts


class InducedSort:
    """One direction of induction; ``forward`` gives the suffixes larger than their successor."""

    def __init__(self, text: np.ndarray, larger: np.ndarray, depth: int, forward: bool, held: int):
        self.text, self.larger, self.depth, self.forward = text, larger, depth, forward
        self.queues = [BucketQueue(held) for _ in range(257)]
        # least common prefix taken out since the last entry of each queue
        self.least = np.zeros(257, np.int64)

    def induce(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """Take sorted entries out (lcp: with the entry taken out before) and queue predecessors."""
        before = np.maximum(at - 1, 0)
        c = self.text[before]
        ok = (at > 0) & (c != END) & (self.larger[before] == self.forward)
        c = np.where(ok, c, -1).astype(np.int16)
        running = np.minimum.accumulate(lcp)
        present = np.flatnonzero(np.bincount(c[ok], minlength=257))
        for s in present.tolist():
            k = np.flatnonzero(c == s)
            least = np.minimum.reduceat(lcp[: k[-1] + 1], np.concatenate(([0], k[:-1] + 1)))
            least[0] = min(self.least[s], running[k[0]])
            self.queues[s].put(before[k], np.minimum(least + 1, self.depth))
            self.least[s] = lcp[k[-1] + 1 :].min() if k[-1] + 1 < len(lcp) else self.depth
        absent = np.ones(257, bool)
        absent[present] = False
        self.least[absent] = np.minimum(self.least[absent], running[-1])


#: Stands after the end of a string between two sample positions: of two strings of which one begins
#: the other, the shorter is larger, since its last symbol is smaller than what follows it.
PAST, NAMED = 257, 7  # 258 ** 7 is below 2 ** 63


def _refine(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sort the rows of equal rank by key; a rank is the place of its first row. Returns the rows that
    are still equal to others."""
    order = np.lexsort((key, rank[rows])) if rank.any() else np.argsort(key)
    rows, key, old = rows[order], key[order], rank[rows[order]]
    group = np.flatnonzero(np.diff(old, prepend=-1))
    part = np.flatnonzero((np.diff(old, prepend=-1) != 0) | (np.diff(key, prepend=key[:1]) != 0))
    sizes = np.diff(np.append(part, len(rows)))
    first = group[np.searchsorted(group, part, "right") - 1]
    rank[rows] = np.repeat(old[part] + part - first, sizes)
    return rows[np.repeat(sizes > 1, sizes)]


def _sample_order(text: np.ndarray, sample: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """The sample in the order of the first ``depth`` symbols; ``stop`` is each one's segment end."""
    m = len(sample)
    last = np.minimum(np.append(sample[1:], len(text)), stop)
    length = np.minimum(last - sample + 1, depth)
    rank, rows = np.zeros(m, np.int64), np.arange(m)
    for begin in range(0, depth, NAMED):  # names of the strings up to the next sample position
        key = np.zeros(len(rows), np.int64)
        for k in range(begin, begin + NAMED):
            key = key * (PAST + 1) + np.where(k < length[rows], text[np.minimum(sample[rows] + k, len(text) - 1)], PAST)
        tied = _refine(rank, rows, key)
        rows = tied[length[tied] > begin + NAMED]
        if not len(rows):
            break
        rows = tied[np.isin(rank[tied], rank[rows])]
    counts = np.bincount(rank, minlength=m)
    rows = np.flatnonzero(counts[rank] > 1)
    span = 1
    while len(rows) and 2 * span <= depth:  # a name covers two symbols at least
        after = np.minimum(rows + span, m - 1)
        key = np.where((rows + span < m) & (stop[after] == stop[rows]), rank[after], -1)
        rows = _refine(rank, rows, key)
        span *= 2
    return sample[np.argsort(rank, kind="stable")]


def common_prefix(text: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, cut at ``depth`` and at segment ``ends``; four 16-bit
    symbols are compared at a time."""
    padded = np.append(text, np.zeros(4, text.dtype)).astype(np.uint64)
    word = padded[:-4] | padded[1:-3] << np.uint64(16) | padded[2:-2] << np.uint64(32) | padded[3:-1] << np.uint64(48)
    stops = (ends[np.searchsorted(ends, x)] - x for x in (a, b))
    most = np.minimum(np.minimum(*stops), depth)
    out, live = most.copy(), np.flatnonzero(most > 0)
    for k in range(0, depth, 4):
        differ = word[a[live] + k] ^ word[b[live] + k]
        ended = differ != 0
        low = differ[ended] & (~differ[ended] + np.uint64(1))
        at = live[ended]
        out[at] = np.minimum(most[at], k + (np.log2(low.astype(np.float64)) // 16).astype(np.int64))
        live = live[~ended]
        live = live[most[live] > k + 4]
        if not len(live):
            break
    return out


def sorted_suffixes(text: np.ndarray, depth: int, held: int = 2**20) -> tuple[np.ndarray, np.ndarray]:
    """Suffix positions in order, and each one's common prefix with the one before.

    ``text`` has symbols 1 to 256 and END after each segment; suffixes at END are left out."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # larger[i]: the suffix at i is larger than the one at i + 1; equal symbols take the type that follows
    step = np.sign(np.diff(text.astype(np.int64), append=END - 1))
    known = np.flatnonzero(step != 0)
    run_end = np.repeat(known, np.diff(known, prepend=-1))  # last position of a run of equal symbols
    larger = step[run_end] < 0
    larger[text == END] = False
    ends = np.flatnonzero(text == END)
    sample = np.flatnonzero(~larger[1:] & larger[:-1] & (text[1:] != END)) + 1
    sample = _sample_order(text, sample, ends[np.searchsorted(ends, sample)], depth) if len(sample) else sample
    sample_lcp = np.zeros(len(sample), np.int64)
    sample_lcp[1:] = common_prefix(text, ends, sample[:-1], sample[1:], depth)
    starts = np.searchsorted(text[sample], np.arange(258))

    def junction(a: int, b: int) -> int:
        """Of the last larger and the first smaller suffix of a bucket: the shorter run."""
        return int(min(run_end[a] - a + 1, run_end[b] - b + 1, depth))

    up = InducedSort(text, larger, depth, True, held)
    up.least[:] = 0
    up.induce(ends, np.zeros(len(ends), np.int64))
    up.least[:] = 0
    large: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(257)]
    for c in range(1, 257):
        last = None
        while rounds := list(up.queues[c].take()):
            for at, lcp in rounds:
                lcp = lcp.copy()
                if last is None:
                    lcp[0] = 0
                large[c].append((at, lcp))
                last = at[-1]
                up.induce(at, lcp)
        a, b = starts[c], starts[c + 1]
        if b > a:
            lcp = sample_lcp[a:b].copy()
            lcp[0] = 0 if last is None else junction(last, sample[a])
            up.induce(sample[a:b], lcp)

    down = InducedSort(text, larger, depth, False, held)
    small: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(257)]
    for c in range(256, 0, -1):
        # from the largest down: lcp of an entry is with the next larger one, taken out before it
        last = None
        while rounds := list(down.queues[c].take()):
            for at, lcp in rounds:
                lcp = lcp.copy()
                if last is None:
                    lcp[0] = 0
                small[c].append((at, lcp))
                last = at[-1]
                down.induce(at, lcp)
        if large[c]:
            at = np.concatenate([x for x, _ in large[c]])[::-1]
            lcp = np.concatenate([x for _, x in large[c]])
            turned = np.concatenate(([0 if last is None else junction(at[0], last)], lcp[:0:-1]))
            down.induce(at, turned)

    out_at, out_lcp = [], []
    for c in range(1, 257):
        at = [x for x, _ in large[c]]
        lcp = [x for _, x in large[c]]
        if small[c]:
            s = np.concatenate([x for x, _ in small[c]])[::-1]
            t = np.concatenate([x for _, x in small[c]])
            first = junction(at[-1][-1], s[0]) if at else 0
            at.append(s)
            lcp.append(np.concatenate(([first], t[:0:-1])))
        out_at += at
        out_lcp += lcp
    if not out_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_at), np.concatenate(out_lcp)
