"""Exact repeats: removes every byte inside a ``length``-byte string that occurs twice.

1. Every window of ``length`` bytes has a minimum over its hashed byte grams;
   equal windows have equal minima.  Consecutive windows of one minimum form a
   run; about two runs fall on each ``length`` bytes.
2. Only minima with two or more occurrences in the corpus can have repeated
   windows.  Equal runs (128-bit digest) are collapsed; a run that occurs twice
   repeats as a whole.
3. Where a minimum has different runs, their bytes go to the shard of that
   minimum, so that any two equal windows meet in one shard.  The shard's suffixes
   are sorted by induced sorting; its queues carry positions with common prefixes and
   hold ``memory`` bytes, the rest is on the task's disk.  Neighbours that share
   ``length`` bytes are repeats.
4. A hot group is split: a minimum of more than ``hot_bytes`` of different runs would be
   a shard that grows with the corpus, so its windows are dealt by digest, packed, each
   that repeats within a task as one record.
5. The covered ranges go back to every copy of a run, and the bytes are removed.

Edge cases: null and empty texts have no bytes and lose none; texts shorter than
``length`` lose nothing.  Repeated rows repeat each other.  Strings are judged
on the input, across rows but never over the border of one.  Columns named like a
result (n_bytes, n_removed, n_spans, kept) are replaced; ``__rid`` and ``__cuts`` are
reserved names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, Scratch, digests, freed, mix64, powers, prefix_hash, slices, span_hash, text_bytes, with_row_id
from .induced_sort import FAR, least, sorted_suffixes

GRAM = 24


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i:i+w] for every full window, in three passes whatever w is."""
    n = len(x)
    if n < w:
        return x[:0]
    fill = np.uint64((1 << 64) - 1) if op is np.minimum else np.uint64(0)
    blocks = np.concatenate([x, np.full(-n % w, fill, np.uint64)]).reshape(-1, w)
    fore = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - w + 1], fore[w - 1 : n])


def window_runs(data: np.ndarray, offs: np.ndarray, length: int):
    """Runs of windows with one minimum: row, first start, number of starts, minimum,
    whether its gram occurs more than once in the run, and the run's digests."""
    n, w = len(data), length - GRAM + 1
    h = prefix_hash(data)
    _, inv = powers(n + 1)
    grams = mix64((h[GRAM:] - h[:-GRAM]) * inv[: n + 1 - GRAM])
    low = sliding(grams, w, np.minimum)
    valid = np.zeros(len(low) + 1, np.int8)
    fits = np.diff(offs) >= length
    np.add.at(valid, offs[:-1][fits], 1)
    np.add.at(valid, offs[1:][fits] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    step = np.ones(len(low), bool)
    step[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    edge = np.zeros(len(low), bool)
    edge[offs[:-1][fits]] = True
    first = np.flatnonzero(valid & (step | edge))
    # a run ends before the next one begins, or where its row's windows end
    row = np.searchsorted(offs, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(low)), offs[row + 1] - length + 1)
    value = low[first]
    reach = np.concatenate([np.zeros(w - 1, np.uint64), np.where(valid, low, 0), np.zeros(w - 1, np.uint64)])
    chosen = np.flatnonzero(grams == sliding(reach, w, np.maximum)[: len(grams)])
    names, code = np.unique(grams[chosen], return_inverse=True)
    key = np.sort(code.astype(np.int64) * (n + 1) + chosen)
    at = np.searchsorted(names, value).astype(np.int64) * (n + 1)
    many = np.searchsorted(key, at + last - 1 + w - 1, side="right") - np.searchsorted(key, at + first) > 1
    end = last - 1 + length
    return row, first - offs[row], last - first, value, many, *digests(data, first, end).T


def _runs(length: int):
    names = ["rid", "start", "size", "v", "many", "g1", "g2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = text_bytes(b.column(1))
            for lo, hi in slices(offs):
                if offs[hi] - offs[lo] < length:
                    continue
                row, start, size, v, many, g1, g2 = window_runs(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], length)
                if len(row):
                    i64 = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (v, g1, g2)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row + lo)), pa.array(start.astype(np.int64)), pa.array(size.astype(np.int64)), i64[0], pa.array(many), *i64[1:]], names
                    )

    return run


def _cut(length: int):
    """(text, wanted) to (block, seg, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, seg, raw = [], [], []
            for t, want in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = t.as_py().encode()
                for x in want:
                    block.append(x["block"])
                    seg.append(x["seg"])
                    raw.append(data[x["start"] : x["start"] + x["size"] - 1 + length])
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(seg, pa.int64()), pa.array(raw, pa.binary())], ["block", "seg", "raw"])

    return run


def _ranges(seg: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Sorted (seg, start) to maximal ranges of starts."""
    new = np.ones(len(seg), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    end = start[np.append(at[1:], len(seg)) - 1] + 1 if len(seg) else start
    return pa.RecordBatch.from_arrays([pa.array(seg[at]), pa.array(start[at]), pa.array(end)], ["seg", "a", "b"])


def shard_repeats(raws: list[bytes], length: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Which (segment index, start) windows occur twice or more among the segments."""
    sizes = np.array([len(r) for r in raws], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
    s = data.astype(np.uint16) + np.uint16(1)
    s[begin[1:] - 1] = 0
    ok = np.zeros(len(data) + 1, np.int8)
    np.add.at(ok, begin[:-1], 1)
    np.add.at(ok, begin[:-1] + np.maximum(sizes - length + 1, 0), -1)
    ok = np.cumsum(ok[:-1]) > 0
    hit = np.zeros(len(data), bool)
    last, low = -1, FAR  # the window before, and what was shared since
    for rows in sorted_suffixes(s, length, memory):
        pos, lcp = rows["pos"], rows["lcp"]
        at = np.flatnonzero(ok[pos])
        if not len(at):
            low = min(low, lcp.min())
            continue
        shared = least(lcp, np.append(0, at[:-1] + 1), at)
        shared[0] = min(shared[0], low)
        twin = shared >= length
        twin[0] &= last >= 0
        mine = pos[at]
        hit[mine[twin]] = True
        hit[np.append(last, mine[:-1])[twin]] = True
        last = int(mine[-1])
        low = lcp[at[-1] + 1 :].min(initial=FAR)
    pos = np.flatnonzero(hit)
    seg = np.searchsorted(begin, pos, side="right") - 1
    return seg, pos - begin[seg]


def _sort_shard(length: int, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segs: list[int] = []
        raws: list[bytes] = []
        for b in batches:
            segs += b.column(1).to_pylist()
            raws += b.column(2).to_pylist()
        if raws:
            seg, start = shard_repeats(raws, length, memory)
            yield _ranges(np.array(segs, np.int64)[seg], start)

    return run


WINDOW = np.dtype([("w1", np.uint64), ("w2", np.uint64), ("seg", np.int64), ("start", np.int64)])


def _second_hash(d: np.ndarray, length: int) -> np.ndarray:
    """Another 64-bit hash of every window, over mixed pairs of bytes."""
    pair = mix64(BYTE_CODE[d[:-1]] * np.uint64(3) + BYTE_CODE[d[1:]])
    pw, inv = powers(len(d) + 1)
    h = np.append(np.uint64(0), np.cumsum(pair * pw[: len(pair)]))
    n = len(d) - length + 1
    return mix64((h[length - 1 : length - 1 + n] - h[:n]) * inv[:n])


def _twice(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rec`` in order of its digests, and which of them have an equal neighbour."""
    rec = rec[np.lexsort((rec["w2"], rec["w1"]))]
    same = (rec["w1"][1:] == rec["w1"][:-1]) & (rec["w2"][1:] == rec["w2"][:-1])
    return rec, np.append(same, False) | np.append(False, same)


def _found(rec: np.ndarray) -> pa.RecordBatch:
    """(seg, start) records as ranges, in the layout of packed windows."""
    rec = rec[np.lexsort((rec["start"], rec["seg"]))]
    r = _ranges(rec["seg"], rec["start"])
    n = r.num_rows
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n) % 997), *r.columns, pa.nulls(n, pa.binary())], ["block", "seg", "a", "b", "data"])


def _window_digests(length: int, blocks: int, most: int = 1 << 19):
    """(block, seg, bytes) to packed digests of the windows, dealt by digest, for split minima.

    A window that repeats here is found here, and stands for its copies with one record."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rec, twin = _twice(np.concatenate(parts))
        yield _found(rec[twin])
        first = twin.copy()
        first[1:] &= (rec["w1"][1:] != rec["w1"][:-1]) | (rec["w2"][1:] != rec["w2"][:-1])
        some = rec[first]
        some["seg"] = -1
        rec = np.concatenate([rec[~twin], some])
        block = (rec["w1"] % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        rec, block = rec[order], block[order]
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, int)
        data = [rec[x:z].tobytes() for x, z in zip(cut, np.append(cut[1:], len(block)), strict=False)]
        none = pa.nulls(len(data), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(block[cut]), none, none, none, pa.array(data, pa.binary())], ["block", "seg", "a", "b", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0
        for b in batches:
            for seg, raw in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                d = np.frombuffer(raw.as_py(), np.uint8)
                at = np.arange(len(d) - length + 1)
                rec = np.empty(len(at), WINDOW)
                rec["w1"], rec["w2"] = span_hash(prefix_hash(d), at, at + length), _second_hash(d, length)
                rec["seg"], rec["start"] = seg, at
                parts.append(rec)
                total += len(rec)
                if total >= most:
                    yield from flush(parts)
                    parts, total = [], 0
        if parts:
            yield from flush(parts)

    return run


def _match_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's packed digests to ranges of repeated starts; found ranges pass through."""
    parts = []
    for b in batches:
        done = b.filter(b.column(4).is_null())
        if done.num_rows:
            yield pa.RecordBatch.from_arrays(done.columns[1:4], ["seg", "a", "b"])
        parts += [np.frombuffer(x.as_py(), WINDOW) for x in b.column(4) if x.is_valid]
    if parts:
        rec, twin = _twice(np.concatenate(parts))
        # a record that stands for copies repeats whatever it meets
        new = np.append(True, (rec["w1"][1:] != rec["w1"][:-1]) | (rec["w2"][1:] != rec["w2"][:-1]))
        group = np.cumsum(new) - 1
        many = np.bincount(group, rec["seg"] < 0)[group] > 0
        hit = rec[(twin | many) & (rec["seg"] >= 0)]
        r = _found(hit)
        yield pa.RecordBatch.from_arrays(r.columns[1:4], ["seg", "a", "b"])


def _remove(length: int, at: int, cover: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, n_gone, n_spans, kept = [], [], [], []
            for t, cuts in zip(b.column(at), b.column(cover).to_pylist(), strict=True):
                data = (t.as_py() or "").encode()
                n_bytes.append(len(data))
                merged: list[list[int]] = []
                for x in sorted(cuts or (), key=lambda x: x["a"]):
                    a, z = x["a"], x["b"] - 1 + length
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(z, merged[-1][1])
                    else:
                        merged.append([a, z])
                n_spans.append(len(merged))
                n_gone.append(sum(z - a for a, z in merged))
                if merged:
                    ends = [0, *(z for _, z in merged)]
                    data = b"".join(data[p:a] for p, (a, _) in zip(ends, merged, strict=False)) + data[ends[-1] :]
                kept.append(data)
            cols = [c for i, c in enumerate(b.columns) if i != cover]
            names = [c for i, c in enumerate(b.schema.names) if i != cover]
            cols += [pa.array(n_bytes, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def repeated_ranges(
    docs: DataFrame, scratch: Scratch, final: Scratch, *, text_col: str = "text", length: int = 400, shard_bytes: int = 2 << 20, hot_bytes: int = 2 << 20, memory: int = 1 << 20
) -> DataFrame:
    """(__rid, cuts): ranges [a, b) of starts of repeated windows, for rows that have any."""
    src = docs.select(F.col("__rid").alias("rid"), F.col(text_col).alias("t"))
    runs = scratch.table(src.mapInArrow(*freed(_runs(length), "rid long, start long, size long, v long, many boolean, g1 long, g2 long")))
    twice = runs.groupBy("v").agg((F.count("*") + F.max(F.col("many").cast("int"))).alias("occ")).where("occ > 1").select("v")
    cand = scratch.table(runs.join(twice, "v"))
    segs = cand.groupBy("v", "g1", "g2").agg(F.count("*").alias("copies"), F.max("many").alias("many"), F.min(F.struct("rid", "start", "size")).alias("one"))
    segs = scratch.table(segs.withColumn("seg", F.monotonically_increasing_id()))
    mixed = segs.groupBy("v").agg(F.count("*").alias("kinds"), F.max("many").alias("any"), F.sum(F.col("one.size") + length).alias("bytes")).where("kinds > 1 or any")
    mixed = scratch.table(mixed.select("v", "bytes"))
    total = mixed.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // shard_bytes))
    todo = segs.join(mixed, "v").select(
        F.col("one.rid").alias("rid"),
        F.struct(
            F.when(F.col("bytes") > hot_bytes, F.lit(-1)).otherwise(F.pmod(F.xxhash64("v"), F.lit(blocks))).cast("long").alias("block"),
            "seg",
            F.col("one.start").alias("start"),
            F.col("one.size").alias("size"),
        ).alias("x"),
    )
    want = todo.groupBy("rid").agg(F.collect_list("x").alias("w"))
    pieces = src.join(want, "rid").select("t", "w").mapInArrow(*freed(_cut(length), "block long, seg long, raw binary"))
    hot = mixed.where(F.col("bytes") > hot_bytes).limit(1).count() > 0
    if hot:
        pieces = scratch.table(pieces)
    found = pieces.where("block >= 0").repartition(blocks, "block").mapInArrow(*freed(_sort_shard(length, memory), "seg long, a long, b long"))
    if hot:
        packed = pieces.where("block < 0").mapInArrow(*freed(_window_digests(length, blocks), "block long, seg long, a long, b long, data binary"))
        found = found.unionByName(packed.repartition(blocks, "block").mapInArrow(*freed(_match_digests, "seg long, a long, b long")))
    whole = segs.where("copies > 1").select("seg", F.lit(0).cast("long").alias("a"), F.col("one.size").alias("b"))
    part = found.join(segs.where("copies > 1").select("seg"), "seg", "left_anti")
    cover = scratch.table(whole.unionByName(part)).join(segs.select("seg", "v", "g1", "g2"), "seg").select("v", "g1", "g2", "a", "b")
    cuts = cand.join(cover, ["v", "g1", "g2"]).select("rid", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).alias("x"))
    return final.table(cuts.groupBy(F.col("rid").alias("__rid")).agg(F.collect_list("x").alias("cuts")))


def remove_repeats(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` plus n_bytes, n_removed, n_spans and kept (the bytes that stay)."""
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    final = Scratch(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        rows = with_row_id(docs.select(*keep), final)
        cuts = repeated_ranges(rows, scratch, final, text_col=text_col, **options)
    df = rows.join(cuts, "__rid", "left").select(*keep, F.col("cuts").alias("__cuts"))
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return df.mapInArrow(*freed(_remove(length=options.get("length", 400), at=keep.index(text_col), cover=len(keep)), schema))
