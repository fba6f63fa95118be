"""Fuzzy line dedup by MinHash: one line of each component of near-equal lines stays.

Lines (split at ``\n``) are compared trimmed and with A-Z lower-cased, as sets
of ``gram``-byte shingles.  Equal lines form a class first (128-bit digest).
Each class has ``HASHES`` MinHash values, and ``BANDS`` sets of ``ROWS`` of them are its
bands; classes that share a band are candidates, verified by exact Jaccard on their
shingle sets, and linked by a distributed union-find.  A pair at similarity 0.8 is a
candidate with probability 0.995, one at 0.9 with more than 0.9999; strangers at 0.05
with 6 in a million, one at 0.1 with 2 in ten thousand, which grows with the square of a
corpus.  So a band key carries all ``HASHES`` values in two bits each: lines of one key that
differ in more of them than a pair at the threshold ever does (one in a million) are no
candidates.  Band keys are never stored: they are shipped packed to the block of their key, where
only keys of two classes or more are kept.  Candidates whose set sizes or sketches rule
the threshold out are dropped before their texts are shipped; that loses none.

The first line of a component, by (id, row, line number), stays; the others
are removed.  Lines of fewer than ``gram`` bytes (trimmed) have no shingles and are
duplicates only where they are equal.  Blank lines are never touched.

Edge cases: null text stays null, with no lines; a text may become empty.  Ids may
be of any ordered type; null ids come last in the order of rows.  Repeated rows are
duplicates of the first.  Columns named like a result (n_lines, n_removed) are
replaced; ``__rid`` and ``__lines`` are reserved names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Scratch, block_count, digests, freed, mix64, slices, text_bytes, with_row_id
from .linking import link_components

HASHES, BANDS, ROWS = 48, 18, 5
#: Words of all MinHash values in two bits each.
WORDS = HASHES // 16
_rng = np.random.Generator(np.random.PCG64(77))
_seeds = _rng.integers(0, 1 << 32, (2, HASHES), dtype=np.uint32)


def _picks() -> np.ndarray:
    """(BANDS, ROWS): each band's MinHash values; all are used before one is used again."""
    deck: list[int] = []
    while len(deck) < BANDS * ROWS:
        new = _rng.permutation(HASHES).tolist()
        # the band that runs over the end of the deck takes none twice
        part = deck[len(deck) - len(deck) % ROWS :]
        deck += [x for x in new if x not in part] + [x for x in new if x in part]
    return np.array(deck[: BANDS * ROWS]).reshape(BANDS, ROWS)


PICKS = _picks()


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trimmed start and end byte, row and number in its row of every line that has a word."""
    n = len(data)
    nl = np.flatnonzero(data == 10)
    empty = np.zeros(0, np.int64)
    if n == 0:
        return empty, empty, empty, empty
    begin = np.union1d(offs[:-1][offs[:-1] < offs[1:]], nl + 1)
    begin = begin[begin < n]
    row = np.searchsorted(offs, begin, side="right") - 1
    before = np.searchsorted(nl, begin) - np.searchsorted(nl, offs[row])
    limit = np.minimum(np.append(begin[1:], n), offs[row + 1])
    solid = np.flatnonzero(~SPACE[data])
    lo, hi = np.searchsorted(solid, begin), np.searchsorted(solid, limit)
    keep = hi > lo
    lo, hi, row, before = lo[keep], hi[keep], row[keep], before[keep]
    return solid[lo], solid[hi - 1] + 1, row, before


def gram_codes(low: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit code of the ``gram`` bytes from every position."""
    m = max(len(low) - gram + 1, 0)
    x, wide = np.zeros(m, np.uint32), low.astype(np.uint32) + np.uint32(1)
    for j in range(gram):
        x *= np.uint32(0x01000193)
        x += wide[j : j + m]
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    return x


def signatures(low: np.ndarray, start: np.ndarray, end: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines, BANDS) 64-bit band keys, and (lines, WORDS) all MinHash values in two bits each;
    lines must be of ``gram`` bytes or more."""
    codes = gram_codes(low, gram)
    cuts = np.empty(2 * len(start), np.int64)
    cuts[::2], cuts[1::2] = start, end - gram + 1
    trim = len(cuts) - (cuts[-1] >= len(codes))
    least, mixed = np.empty((HASHES, len(start)), np.uint64), np.empty_like(codes)
    for p in range(HASHES):
        np.bitwise_xor(codes, _seeds[0, p], out=mixed)
        np.multiply(mixed, _seeds[1, p] | np.uint32(1), out=mixed)
        least[p] = np.minimum.reduceat(mixed, cuts[:trim])[::2]
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(start), axis=1)
    for picks in PICKS.T:
        out = mix64(out * np.uint64(31) + least[picks])
    two = (mix64(least) >> np.uint64(62)).astype(np.uint32)
    sig = np.zeros((len(start), WORDS), np.uint32)
    for p in range(HASHES):
        sig[:, p // 16] |= two[p] << np.uint32(2 * (p % 16))
    return out.T, sig


def most_apart(pct: int, loss: float = 1e-6) -> int:
    """The most MinHash values, of all in two bits, in which a pair at ``pct`` that shares a band
    differs, but for a share of ``loss`` of such pairs."""
    free, p = HASHES - ROWS, (100 - pct) / 100 * 3 / 4
    tail, k = 1.0, -1
    while tail >= loss:
        k += 1
        tail -= comb(free, k) * p**k * (1 - p) ** (free - k)
    return k


#: Bytes of a vectorised step: its arrays stay in a core's cache.
SLICE = 1 << 18


def _spans(batches: Iterator[pa.RecordBatch], least: int, text_at: int):
    """Slices of batches: batch, lower-cased bytes, and start, end, row in batch and
    number of their lines of ``least`` bytes or more."""
    for b in batches:
        all_data, all_offs = text_bytes(b.column(text_at))
        for lo, hi in slices(all_offs, SLICE):
            data, offs = all_data[all_offs[lo] : all_offs[hi]], all_offs[lo : hi + 1] - all_offs[lo]
            start, end, row, line = line_spans(data, offs)
            keep = end - start >= least
            if keep.any():
                yield b, LOWER[data], start[keep], end[keep], row[keep] + lo, line[keep]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, id, text) to (rid, id, line, h1, h2)."""
    for b, low, start, end, row, line in _spans(batches, 1, 2):
        h, at = digests(low, start, end), pa.array(row)
        cols = [b.column(0).take(at), b.column(1).take(at), pa.array(line.astype(np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in h.T)]
        yield pa.RecordBatch.from_arrays(cols, ["rid", "id", "line", "h1", "h2"])


#: A packed band: the key's upper half (its block tells the rest), 48 bits of the line's digest
#: (a stranger of the same 48 bits is one candidate more, which the check rules out), and its MinHash
#: values in two bits each.
REC = np.dtype([("key", np.uint32), ("low", np.uint32), ("high", np.uint16), ("sig", np.uint32, (WORDS,))])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)
    return cut, np.append(cut[1:], len(x))[: len(cut)].astype(int)


def _bands(gram: int, blocks: int, most: int = 1 << 19):
    """(text) to packed band keys, by block of the key; a line that the task remembers is not
    sent again."""

    def flush(keys: list[np.ndarray], lines: list[np.ndarray], sigs: list[np.ndarray]) -> pa.RecordBatch:
        key, h, sig = np.concatenate(keys).ravel(), np.concatenate(lines), np.concatenate(sigs)
        block = (key % np.uint64(blocks)).astype(np.uint16 if blocks <= 1 << 16 else np.int64)
        order = np.argsort(block, kind="stable")
        block, at = block[order], order // BANDS
        rec = np.empty(len(order), REC)
        rec["key"], rec["sig"], own = key[order] >> np.uint64(32), sig[at], h[at]
        rec["low"], rec["high"] = own & np.uint64(0xFFFFFFFF), own >> np.uint64(32)
        begin, end = _runs(block)
        data = [rec[a:z].tobytes() for a, z in zip(begin, end, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[begin].astype(np.int64)), pa.array(data, pa.binary())], ["block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, lines, sigs, total = [], [], [], 0
        for _, low, start, end, _, _ in _spans(batches, gram, 0):
            h = digests(low, start, end)[:, 0].view(np.uint64) >> np.uint64(16)
            new = []
            for i, x in enumerate(h.tolist()):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            if len(seen) >= most:
                seen.clear()
            if not new:
                continue
            key, sig = signatures(low, start[new], end[new], gram)
            keys.append(key)
            lines.append(h[new])
            sigs.append(sig)
            total += key.size
            if total >= most:
                yield flush(keys, lines, sigs)
                keys, lines, sigs, total = [], [], [], 0
        if keys:
            yield flush(keys, lines, sigs)

    return run


#: Up to this many lines of a key are held against each other by their MinHash values; of a
#: larger key all lines stay.
HELD = 128


def _alike(sig: np.ndarray, begin: np.ndarray, size: np.ndarray, apart: int) -> np.ndarray:
    """Which rows have another of their run (of two rows or more) that differs in ``apart`` values at most."""
    keep = np.repeat(size > HELD, size)
    one = sig[:, 0].astype(np.uint64) | sig[:, 1].astype(np.uint64) << np.uint64(32), sig[:, 2]
    for m in np.unique(size[size <= HELD]).tolist():
        runs = begin[size == m]
        step = max(1, (1 << 20) // (m * m))
        for lo in range(0, len(runs), step):
            at = runs[lo : lo + step, None] + np.arange(m)
            odd = np.zeros((len(at), m, m), np.uint8)
            for word, mask in zip(one, (np.uint64(0x5555555555555555), np.uint32(0x55555555)), strict=True):
                x = word[at][:, :, None] ^ word[at][:, None, :]
                odd += np.bitwise_count((x | x >> x.dtype.type(1)) & mask)
            near = odd <= apart
            near[:, np.arange(m), np.arange(m)] = False
            keep[at] = near.any(axis=2)
    return keep


def _shared(pct: int):
    """Packed band keys to (key, h) of the keys that two lines or more have; a line goes where
    its MinHash values are unlike those of all others.  Keys of the same lines get one name."""
    apart = most_apart(pct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blocks.setdefault(block, []).append(data)
        while blocks:
            rec = np.frombuffer(b"".join(blocks.popitem()[1]), REC)
            both = np.sort(rec["key"].astype(np.uint64) << np.uint64(32) | np.arange(len(rec), dtype=np.uint64))
            key = both >> np.uint64(32)
            same = key[1:] == key[:-1]
            many = np.append(same, False) | np.append(False, same)
            key, rec = key[many], rec[(both[many] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            h = rec["low"].astype(np.uint64) | rec["high"].astype(np.uint64) << np.uint64(32)
            order = np.lexsort((h, key))
            key, h, sig = key[order], h[order], rec["sig"][order]
            new = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]))[: len(key)]
            key, h, sig = key[new], h[new], sig[new]
            begin, end = _runs(key)
            keep = _alike(sig, begin, end - begin, apart)
            key, h = key[keep], h[keep]
            begin, end = _runs(key)
            if not len(begin):
                continue
            name = np.repeat(np.bitwise_xor.reduceat(mix64(h + np.uint64(1)), begin) + (end - begin).astype(np.uint64), end - begin)
            for a in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)].view(np.int64)) for x in (name, h)], ["key", "h"])

    return run


def line_grams(raw: bytes, gram: int) -> np.ndarray:
    """The whole shingles (up to 8 bytes) at every position of some bytes, as integers."""
    low = np.frombuffer(raw, np.uint8).astype(np.uint64)
    x = np.zeros(max(len(low) - gram + 1, 0), np.uint64)
    for j in range(gram):
        x |= low[j : j + len(x)] << np.uint64(8 * j)
    return x


def gram_set(text: str, gram: int) -> np.ndarray:
    """Sorted distinct shingles of a line."""
    x = line_grams(text.encode().translate(TABLE).strip(BLANK), gram)
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])]


TABLE, BLANK = bytes(LOWER.tolist()), bytes(np.flatnonzero(SPACE).tolist())
#: Longs of a sketch: each shingle of a line flips one of their bits.
SKETCH = 16
SKETCHES = [f"s{i}" for i in range(SKETCH)]


def sketches(lines: list[bytes], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct shingles, and the sketch, of each line (lower-cased, trimmed)."""
    n = np.array([len(x) - gram + 1 for x in lines], np.int64)
    data = b"".join(lines)
    at = np.arange(int(n.sum())) + np.repeat(np.arange(len(n)) * (gram - 1), n)
    grams, own = line_grams(data, gram)[at], np.repeat(np.arange(len(n)), n)
    if 8 * gram + len(n).bit_length() <= 64:
        high = np.uint64(8 * gram)
        both = np.sort(own.astype(np.uint64) << high | grams)
        both = both[np.append(True, both[1:] != both[:-1])]
        own, grams = (both >> high).astype(np.int64), both & np.uint64((1 << 8 * gram) - 1)
    else:
        order = np.lexsort((grams, own))
        grams, own = grams[order], own[order]
        new = np.append(True, (grams[1:] != grams[:-1]) | (own[1:] != own[:-1]))
        grams, own = grams[new], own[new]
    width = 64 * SKETCH
    bit = (mix64(grams) >> np.uint64(40)).astype(np.int64) % width
    bits = (np.bincount(own * width + bit, minlength=len(n) * width) & 1).astype(np.uint8)
    return np.bincount(own, minlength=len(n)), np.packbits(bits.reshape(len(n), width), axis=1).view(np.int64)


def may_match(pct: int):
    """Whether two (size, sketch) can be at ``pct``; never false for a pair that is.

    At similarity p at most (a + b)(1 - p) / (1 + p) shingles are in one set only, and those
    that both have flip the same bits, so a bit that differs stands for one of them at least."""

    def test(a: Column, b: Column) -> Column:
        odd = sum((F.bit_count(a[x].bitwiseXOR(b[x])) for x in SKETCHES), F.lit(0))
        fits = F.least(a["size"], b["size"]) * 100 >= F.greatest(a["size"], b["size"]) * pct
        return fits & (odd * (100 + pct) <= (a["size"] + b["size"]) * (100 - pct))

    return test


def _pick(gram: int, most: int = 1 << 18):
    """(text, wanted: [(cid, line)]) to (cid, line text, number of shingles, sketch)."""
    names = ["cid", "t", "size", *SKETCHES]

    def flush(cids: list, texts: list[str], lines: list[bytes]) -> pa.RecordBatch:
        sizes, own = sketches(lines, gram)
        cols = [pa.array(cids, pa.int64()), pa.array(texts, pa.string()), pa.array(sizes), *(pa.array(np.ascontiguousarray(x)) for x in own.T)]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids, texts, lines, total = [], [], [], 0
        for b in batches:
            for t, want in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                parts = t.as_py().split("\n")
                for x in want:
                    cids.append(x["cid"])
                    texts.append(parts[x["line"]])
                    lines.append(texts[-1].encode().translate(TABLE).strip(BLANK))
                    total += len(lines[-1])
                if total >= most:
                    yield flush(cids, texts, lines)
                    cids, texts, lines, total = [], [], [], 0
        if cids:
            yield flush(cids, texts, lines)

    return run


def _verify(gram: int, pct: int, kept: int = 1024):
    """(a, b, text a, text b) to the pairs at or above the threshold; the shingle sets of
    the last ``kept`` lines are remembered, as pairs come in groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(cid: int, text: pa.StringScalar) -> np.ndarray:
            got = sets.get(cid)
            if got is None:
                if len(sets) >= kept:
                    sets.pop(next(iter(sets)))
                got = sets[cid] = gram_set(text.as_py(), gram)
            return got

        for b in batches:
            src, dst = [], []
            for a, c, ta, tc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                x, y = of(a, ta), of(c, tc)
                if len(x) > len(y):
                    x, y = y, x
                if len(x) * 100 < len(y) * pct:
                    continue
                i = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if i * 100 >= (len(x) + len(y) - i) * pct:
                    src.append(a)
                    dst.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _rebuild(text_at: int, drop_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_gone = [], [], []
            for t, drop in zip(b.column(text_at), b.column(drop_at).to_pylist(), strict=True):
                t = t.as_py()
                n_lines.append(t.count("\n") + 1 if t is not None else 0)
                n_gone.append(len(drop or ()))
                if drop:
                    gone = set(drop)
                    t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in gone])
                texts.append(t)
            cols = list(b.columns)
            cols[text_at] = pa.array(texts, pa.string())
            del cols[drop_at]
            names = [n for i, n in enumerate(b.schema.names) if i != drop_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], [*names, "n_lines", "n_removed"])

    return run


def _removed(src: DataFrame, scratch: Scratch, final: Scratch, pct: int, gram: int) -> DataFrame:
    """src: (rid, id, t).  (__rid, lines): the numbers of the lines to remove, for rows that lose any."""
    kind, blocks = src.schema["id"].dataType.simpleString(), block_count(src)
    lines = scratch.table(src.select("rid", "id", "t").mapInArrow(*freed(_lines, f"rid long, id {kind}, line int, h1 long, h2 long")), dictionary=False)
    packed = src.select("t").mapInArrow(*freed(_bands(gram, blocks), "block long, data binary"))
    shared = scratch.table(packed.repartition(blocks, "block").mapInArrow(*freed(_shared(pct), "key long, h long")).distinct())
    # only classes of several lines, or with a line of a shared key, are stored; any line of a class has its text
    classes = lines.groupBy("h1", "h2").agg(F.first("rid").alias("rid"), F.first("line").alias("line"), F.count("*").alias("m"))
    short = shared.select("h").distinct().withColumn("near", F.lit(True))
    classes = classes.withColumn("h", F.shiftrightunsigned("h1", 16)).join(short.hint("shuffle_hash"), "h", "left").where("m > 1 or near")
    classes = scratch.table(classes.withColumn("cid", F.monotonically_increasing_id()))
    near = classes.where("near")
    buckets = shared.join(near.select("h", "cid", "m"), "h").select("key", F.col("cid").alias("id"), F.col("m").alias("score"))
    buckets = scratch.table(buckets)
    longs = ", ".join(f"{x} long" for x in SKETCHES)
    want = near.groupBy("rid").agg(F.collect_list(F.struct("cid", "line")).alias("w"))
    texts = scratch.table(src.select("rid", "t").join(want.hint("shuffle_hash"), "rid").select("t", "w").mapInArrow(*freed(_pick(gram), f"cid long, t string, size long, {longs}")))

    def verify(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("cid").alias("a"), F.col("t").alias("ta"))
        b = texts.select(F.col("cid").alias("b"), F.col("t").alias("tb"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(*freed(_verify(gram, pct), "src long, dst long"))

    shapes = texts.select(F.col("cid").alias("id"), F.struct("size", *SKETCHES).alias("n"))
    labels = link_components(buckets, shapes, verify, may_match(pct), scratch)
    alike = classes.where("m > 1")
    if labels is not None:
        alike = classes.join(labels.select(F.col("id").alias("cid"), "comp"), "cid", "left").where("m > 1 or comp is not null")
        alike = alike.withColumn("comp", F.coalesce("comp", "cid"))
    else:
        alike = alike.withColumn("comp", F.col("cid"))
    hits = scratch.table(lines.join(alike.select("h1", "h2", "comp").hint("shuffle_hash"), ["h1", "h2"]).select("comp", "id", "rid", "line"))
    place = F.struct(F.col("id").isNull().alias("o"), "id", "rid", "line")
    best = scratch.table(hits.groupBy("comp").agg(F.min(place).alias("best")).select("comp", F.col("best.rid").alias("r"), F.col("best.line").alias("l")))
    gone = hits.join(best, "comp").where("rid <> r or line <> l")
    return final.table(gone.groupBy(F.col("rid").alias("__rid")).agg(F.collect_list("line").alias("__lines")))


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    pct: int = 80,
    gram: int = 5,
) -> DataFrame:
    """``docs`` with the text less its removed lines, plus n_lines and n_removed."""
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    final = Scratch(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        own = with_row_id(docs.select(*keep), final)
        src = own.select(F.col("__rid").alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        gone = _removed(src, scratch, final, pct, gram)
    df = own.join(gone.hint("shuffle_hash"), "__rid", "left").select(*keep, "__lines")
    schema = docs.select(*keep).schema.add("n_lines", "long").add("n_removed", "long")
    return df.mapInArrow(*freed(_rebuild(keep.index(text_col), len(keep)), schema))
