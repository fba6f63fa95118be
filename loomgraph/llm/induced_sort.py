"""External induced sorting of one shard's suffixes, with common-prefix values.

``sorted_suffixes`` yields the suffixes of a string in descending order, each with the
common prefix (up to ``depth``) that it shares with the next one in ascending order.

* The left-most S-type suffixes are sorted first: their substrings by an induction of
  their own, the string of their names by rank tuples of doubling length.  The ranks of
  every length are kept and tell the common prefixes of the sorted ones.
* Then all L-type suffixes are induced in ascending and all S-type ones in descending
  order.  The priority queue of such a scan is monotone, ordered by (first value, time of
  insertion), so it is one first-in-first-out queue for each value.
* A queue's tuples are (position, common prefix with the tuple before it).  When a suffix
  puts its predecessor into a queue, the value is one more than the least common prefix
  on the way from the last suffix that fed this queue: no text is compared but where the
  L-type and the S-type suffixes of one value meet.
* Queues hold ``memory`` bytes; beyond that their tuples go to a temporary file and come
  back in pieces.  A text of more bytes is a mapped temporary file too.  All files are
  the task's own and go with it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

ENTRY = np.dtype([("pos", np.int32), ("lcp", np.uint16)])
PIECE = 1 << 16
FAR = np.uint16(65535)


def on_disk(a: np.ndarray, memory: int) -> np.ndarray:
    """``a`` as it is, or as a mapped temporary file if it is larger than ``memory``."""
    if a.nbytes <= memory or not len(a):
        return a
    file = tempfile.TemporaryFile(prefix="loomgraph-text-")
    out = np.memmap(file, a.dtype, "w+", shape=a.shape)
    out[:] = a
    return out.view(np.ndarray)


class Queues:
    """First-in-first-out queues of tuples, one for each value."""

    def __init__(self, n: int, memory: int):
        self.parts: list[list] = [[] for _ in range(n)]
        self.held, self.memory = 0, memory
        self.file = None
        self.spilled = 0

    def push(self, c: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if self.held + rows.nbytes > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile(prefix="loomgraph-queue-")
            at = self.file.seek(0, 2)
            self.file.write(rows.tobytes())
            self.parts[c].append((at, len(rows)))
            self.spilled += rows.nbytes
        else:
            self.held += rows.nbytes
            self.parts[c].append(rows)

    def _read(self, p) -> np.ndarray:
        if isinstance(p, tuple):
            self.file.seek(p[0])
            return np.frombuffer(self.file.read(p[1] * ENTRY.itemsize), ENTRY)
        self.held -= p.nbytes
        return p

    def pop(self, c: int) -> Iterator[np.ndarray]:
        """All that is queued for ``c`` now, in order, in bounded pieces."""
        out, self.parts[c] = self.parts[c], []
        small: list[np.ndarray] = []
        n = 0
        for p in out:
            rows = self._read(p)
            small.append(rows)
            n += len(rows)
            if n >= PIECE:
                yield np.concatenate(small)
                small, n = [], 0
        if small:
            yield np.concatenate(small)

    def pop_back(self, c: int) -> Iterator[np.ndarray]:
        """All that is queued for ``c``, in pieces from the last to the first, each in order."""
        out, self.parts[c] = self.parts[c], []
        for p in reversed(out):
            yield self._read(p)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Feeder:
    """Puts predecessors into queues, with the least common prefix since each queue was fed."""

    def __init__(self, s: np.ndarray, stype: np.ndarray, sigma: int, want: bool, depth: int, queues: Queues):
        self.s, self.stype, self.want, self.depth, self.queues = s, stype, want, depth, queues
        self.since = np.full(sigma, FAR)

    def feed(self, rows: np.ndarray) -> None:
        """``rows`` in scan order; a row's lcp is shared with the row scanned before it.  With a
        depth of 1 only the order counts."""
        pos, lcp = rows["pos"], rows["lcp"]
        pred = np.maximum(pos, 1) - 1
        at = np.flatnonzero((pos > 0) & (self.stype[pred] == self.want))
        if not len(at):
            if len(lcp) and self.depth > 1:
                self.since = np.minimum(self.since, lcp.min())
            return
        value = self.s[pred[at]]
        order = np.argsort(value, kind="stable")
        at, value = at[order], value[order]
        first = np.append(True, value[1:] != value[:-1])
        begin = np.flatnonzero(first)
        last = np.append(begin[1:], len(at)) - 1
        if self.depth == 1:  # no common prefixes are asked for
            out = entries(pred[at], 0)
            for a, z in zip(begin.tolist(), (last + 1).tolist(), strict=True):
                self.queues.push(int(value[a]), out[a:z])
            return
        # least common prefix of the rows after the feeding before, up to this one
        before = np.append(0, at[:-1] + 1)
        before[first] = 0
        low = least(lcp, before, at)
        low[first] = np.minimum(low[first], self.since[value[first]])
        out = np.empty(len(at), ENTRY)
        out["pos"], out["lcp"] = pred[at], np.minimum(low.astype(np.int32) + 1, self.depth)
        for a, z in zip(begin.tolist(), (last + 1).tolist(), strict=True):
            self.queues.push(int(value[a]), out[a:z])
        self.since = np.minimum(self.since, lcp.min())
        rest = at[last] + 1
        here = np.full(len(rest), FAR)
        some = rest < len(lcp)
        here[some] = least(lcp, rest[some], np.full(int(some.sum()), len(lcp) - 1))
        self.since[value[begin]] = here


def least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of x[a..b], both ends included."""
    if not len(a):
        return x[:0]
    width = b - a + 1
    level = np.frexp(width.astype(float))[1] - 1
    out = np.empty(len(a), x.dtype)
    table, k = x, 0
    while True:
        here = level == k
        if here.any():
            out[here] = np.minimum(table[a[here]], table[b[here] - (1 << k) + 1])
        if k >= level.max():
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True for S-type: smaller than the suffix one further on (the end is smallest)."""
    n = len(s)
    if n == 0:
        return np.zeros(0, bool)
    nxt = np.append(s[1:].astype(np.int32), -1)
    at = np.where(nxt != s, np.arange(n, dtype=np.int32), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return (s < nxt)[at]


def common_prefix(s: np.ndarray, a: int, b: int, depth: int) -> int:
    """Compared in the text, in pieces: for the two suffixes where types meet."""
    n = len(s) - max(a, b)
    k = 0
    while k < min(n, depth):
        m = min(64, n - k, depth - k)
        differ = np.flatnonzero(s[a + k : a + k + m] != s[b + k : b + k + m])
        if len(differ):
            return k + int(differ[0])
        k += m
    return min(k, depth)


def entries(pos: np.ndarray, lcp: np.ndarray | int) -> np.ndarray:
    out = np.empty(len(pos), ENTRY)
    out["pos"], out["lcp"] = pos, lcp
    return out


def induce(s: np.ndarray, stype: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, depth: int, memory: int) -> Iterator[np.ndarray]:
    """All suffixes in descending order from the sorted left-most S-type ones, as pieces of
    tuples; a tuple's lcp is shared with the tuple yielded before it.

    With seeds in text order (and no lcp) it orders the left-most S-type *substrings*."""
    n, sigma = len(s), int(s.max()) + 1
    low, seed, larger, up = (Queues(sigma, memory) for _ in range(4))
    try:
        value = s[seeds]
        order = np.argsort(value, kind="stable")
        rows = entries(seeds[order], seed_lcp[order])
        value = value[order]
        begin = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, int)
        rows["lcp"][begin] = 0
        for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(value)], strict=False):
            seed.push(int(value[a]), rows[a:z])
        low.push(int(s[n - 1]), entries(np.array([n - 1]), 0))
        up_from = Feeder(s, stype, sigma, False, depth, low)
        for c in range(sigma):
            last, head = -1, True
            while low.parts[c]:
                for rows in low.pop(c):
                    if head:
                        rows = rows.copy()
                        rows["lcp"][0], head = 0, False
                    larger.push(c, rows)
                    last = int(rows["pos"][-1])
                    up_from.feed(rows)
            for rows in seed.pop(c):
                if last >= 0:  # the largest L-type suffix of a value meets its smallest S-type seed
                    rows = rows.copy()
                    rows["lcp"][0], last = common_prefix(s, last, int(rows["pos"][0]), depth), -1
                up_from.feed(rows)
        down = Feeder(s, stype, sigma, True, depth, up)
        hold = 0  # the common prefix of the suffix scanned last and the next smaller one

        def scanned(rows: np.ndarray) -> np.ndarray:
            down.feed(rows)
            return rows

        for c in range(sigma - 1, -1, -1):
            hold, last = 0, -1
            while up.parts[c]:
                for rows in up.pop(c):
                    rows = rows.copy()
                    if last < 0:
                        rows["lcp"][0] = 0
                    last = int(rows["pos"][-1])
                    yield scanned(rows)
            for rows in larger.pop_back(c):
                # ascending tuples know the one before them; descending ones the one after
                pos, lcp = rows["pos"][::-1], rows["lcp"][::-1]
                if last >= 0:
                    hold, last = common_prefix(s, last, int(pos[0]), depth), -1
                out = entries(pos, np.append(np.uint16(hold), lcp[:-1]))
                hold = int(lcp[-1])
                yield scanned(out)
    finally:
        for q in (low, seed, larger, up):
            q.close()


def _ranks(names: np.ndarray, size: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks by 1, 2, 4, ... names, until all are distinct or equal ones agree on ``depth`` values."""
    out, n, step = [names.astype(np.int32)], len(names), 1
    reach = np.append(np.cumsum(size), np.full(1, size.sum()))
    while step < n and int(out[-1].max()) + 1 < n:
        ends = reach[np.minimum(np.arange(n) + step - 1, n - 1)] - np.append(0, reach)[:n]
        if ends.min() >= depth:
            break
        nxt = np.full(n, -1, np.int64)
        nxt[: n - step] = out[-1][step:]
        out.append(np.unique(out[-1].astype(np.int64) * (n + 2) + nxt + 1, return_inverse=True)[1].astype(np.int32))
        step *= 2
    return out


def _seed_lcp(s: np.ndarray, lms: np.ndarray, order: np.ndarray, ranks: list[np.ndarray], depth: int) -> np.ndarray:
    """Common prefixes of neighbours in ``order`` (indexes of ``lms``): whole names by the kept
    ranks, the names that differ in the text."""
    m = len(lms)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        while True:
            live = np.flatnonzero((np.maximum(a, b) < m))
            live = live[ranks[k][a[live]] == ranks[k][b[live]]]
            live = live[lms[a[live]] - lms[order[live]] < depth]
            if not len(live):
                break
            a[live] = np.minimum(a[live] + step, m)
            b[live] = np.minimum(b[live] + step, m)
            if k < len(ranks) - 1:
                break
    ends = np.append(lms, len(s))
    done = ends[a] - lms[order[:-1]]
    done = np.minimum(done, ends[b] - lms[order[1:]])
    live = np.flatnonzero(done < depth)
    while len(live):
        x, y = lms[order[live]] + done[live], lms[order[live + 1]] + done[live]
        inside = np.maximum(x, y) < len(s)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[s[x] == s[y]]
        done[live] += 1
        live = live[done[live] < depth]
    return np.append(0, np.minimum(done, depth)).astype(np.uint16)


def sorted_suffixes(s: np.ndarray, depth: int, memory: int) -> Iterator[np.ndarray]:
    """Pieces of (pos, lcp) in descending order of the suffixes' first ``depth`` values; lcp is
    shared with the tuple yielded before (0 for the first)."""
    n = len(s)
    if n == 0:
        return
    depth = min(depth, int(FAR) - 1)
    s = on_disk(s, memory)
    stype = on_disk(suffix_types(s), memory)
    lms = np.flatnonzero(stype[1:] & ~stype[:-1]) + 1
    none = np.zeros(len(lms), np.uint16)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        rough = np.concatenate([p["pos"][is_lms[p["pos"]]] for p in induce(s, stype, lms, none, 1, memory)])[::-1].astype(np.int64)
        index = np.zeros(n, np.int32)
        index[lms] = np.arange(len(lms))
        size = np.append(lms[1:], n) - lms
        a, b = index[rough[:-1]], index[rough[1:]]
        # equal substrings, with the first value of the next, have one name
        same = (size[a] == size[b]) & (a < len(lms) - 1) & (b < len(lms) - 1)
        live, k = np.flatnonzero(same), 0
        while len(live):
            live = live[k <= size[a[live]]]
            eq = s[lms[a[live]] + k] == s[lms[b[live]] + k]
            same[live[~eq]] = False
            live, k = live[eq], k + 1
        names = np.zeros(len(lms), np.int64)
        names[index[rough]] = np.concatenate([[0], np.cumsum(~same)])
        ranks = _ranks(names, size, depth)
        order = np.argsort(ranks[-1], kind="stable")
        none = _seed_lcp(s, lms, order, ranks, depth)
        lms = lms[order]
    yield from induce(s, stype, lms, none, depth, memory)
