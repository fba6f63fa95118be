"""N-gram Jaccard self-join: a size-aware heavy-light join over word shingles.

Exact at the threshold: two documents link when ``100 * |A & B| >= pct * |A | B|``.

* A counting pass drops documents that cannot have a partner: of
  the l-prefix of a set (in hash order) a partner shares at least l shingles, so
  a document with fewer prefix shingles that occur in any other prefix has no
  link.  Documents of one shingle set form a class; only its representative is
  joined.  The pass ships packed blocks by shingle hash; a shingle that repeats
  within a mapper's block is counted there, so a frequent one costs one record
  a block however many documents have it.
* Document frequencies come from a second exchange of packed postings; a shingle
  that repeats within a mapper's block is again one record a block.
* Light sets (up to a size chosen by cost) enumerate the subsets of every size
  that a link would need and meet on equal subsets.
* Heavy sets scan inverted lists over their prefix in order of rising document
  frequency, so lists of frequent passages are hardly ever entered.
* Shingles of one document only, and a sketch of the others, rule most false
  candidates out; the rest are verified on the full sets, and linked by ``linking``.

Edge cases: null text and text without words: an empty set, linked with
nothing.  Fewer than ``k`` words: the word sequence is the only shingle.
Repeated rows are one class.  Ids may be of any ordered type; a null id is
possible and never the smallest.  ``keep_one`` keeps all columns, whatever they are
called, but ``__rid``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, Scratch, block_count, freed, mix64, slices, text_bytes, with_row_id, word_shingles
from .linking import link_components

FLUSH = 1 << 20
LOCAL = 0xFFFFFFFF


def least_overlap(n: int, pct: int) -> int:
    """Least overlap of a set of n with any similar set."""
    return -(-n * pct // 100)


def prefix_extra(n: int) -> int:
    """l of the counting pass's l-prefix."""
    return max(1, n // 10)


def _sets_of_text(k: int):
    def sets(b: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
        data, offs = text_bytes(b.column(b.num_columns - 1))
        for lo, hi in slices(offs):
            yield lo, word_shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)

    return sets


def _prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    f1 = np.array([int(mix64(s + MIX[50]).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
    f2 = np.array([int(mix64(s * MIX[51] + MIX[52]).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
    return f1, f2


def _cut(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal values."""
    begin = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, int)
    return begin, np.append(begin[1:], len(block))[: len(begin)].astype(int)


HEAD = ("rids", "sizes", "counts", "f1", "f2")


def _ship(sets, blocks: int, pct: int):
    """Rows (rid, text) to packed blocks of (shingle code, row), and one head a group
    with its rows and their local counts."""
    names = ["block", "grp", "data", *HEAD]

    def flush(rids: list, sizes: list, parts: list[np.ndarray], f1: list, f2: list) -> pa.RecordBatch:
        grp = rids[0]
        row = np.repeat(np.arange(len(rids)), [len(p) for p in parts])
        code = mix64(np.concatenate(parts) + MIX[61])
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        start, end = _cut(code)
        size = end - start
        counts = np.bincount(row[np.repeat(size > 1, size)], minlength=len(rids))
        rec = np.empty(len(start), np.dtype([("code", np.uint32), ("row", np.uint32)]))
        rec["code"] = (code[start] >> np.uint64(32)).astype(np.uint32)
        rec["row"] = np.where(size > 1, LOCAL, row[start])
        block = (code[start] % np.uint64(blocks)).astype(np.int64)
        by = np.argsort(block, kind="stable")
        rec, block = rec[by], block[by]
        begin, end = _cut(block)
        data = [rec[a:z].tobytes() for a, z in zip(begin, end, strict=True)]
        m = len(data)
        head = (np.array(rids, np.int64), np.array(sizes, np.int64), counts.astype(np.int64), np.concatenate(f1), np.concatenate(f2))
        cols = [
            pa.array([*block[begin].tolist(), grp % blocks], pa.int32()),
            pa.array([grp] * (m + 1), pa.int64()),
            pa.array([*data, b""], pa.binary()),
            *(pa.array([None] * m + [x.tobytes()], pa.binary()) for x in head),
        ]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, sizes, parts, f1, f2, total = [], [], [], [], [], 0
        for b in batches:
            all_rids = b.column(0).to_pylist()
            for lo, found in sets(b):
                for i, s in enumerate(found):
                    n = len(s)
                    take = n - least_overlap(n, pct) + prefix_extra(n) if n else 0
                    rids.append(all_rids[lo + i])
                    sizes.append(n)
                    parts.append(s[:take])
                    total += len(parts[-1])
                for all_f, f in zip((f1, f2), _prints(found), strict=True):
                    all_f.append(f)
                if total >= FLUSH or len(rids) >= FLUSH:
                    yield flush(rids, sizes, parts, f1, f2)
                    rids, sizes, parts, f1, f2, total = [], [], [], [], [], 0
        if rids:
            yield flush(rids, sizes, parts, f1, f2)

    return run


HEADS = ", ".join(f"{x} binary" for x in HEAD)
COUNTS = f"grp long, rows binary, own binary, {HEADS}"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks to each group's rows with the number of shingles that other rows have
    too; the groups' heads pass through."""
    names = ["grp", "rows", "own", *HEAD]
    recs: list[np.ndarray] = []
    grps: list[np.ndarray] = []
    blocks: list[np.ndarray] = []
    empty = pa.nulls(1, pa.binary())
    for b in batches:
        block, grp = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, data in enumerate(b.column(2)):
            if d := data.as_py():
                rec = np.frombuffer(d, np.dtype([("code", np.uint32), ("row", np.uint32)]))
                recs.append(rec)
                grps.append(np.full(len(rec), grp[i], np.int64))
                blocks.append(np.full(len(rec), block[i], np.int32))
            elif b.column(3)[i].is_valid:
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, 1), empty, empty, *(c.slice(i, 1) for c in b.columns[3:])], names)
    if not recs:
        return
    rec, grp, block = np.concatenate(recs), np.concatenate(grps), np.concatenate(blocks)
    recs.clear()
    grps.clear()
    key = block.astype(np.uint64) << np.uint64(32) | rec["code"].astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    # a shingle that a mapper met in several rows needs no second mapper
    twice |= rec["row"][order] == LOCAL
    own = order[twice]
    own = own[rec["row"][own] != LOCAL]
    own = own[np.argsort(grp[own], kind="stable")]
    for a, z in zip(*_cut(grp[own]), strict=True):
        rows, counts = np.unique(rec["row"][own[a:z]], return_counts=True)
        nulls = [pa.nulls(1, pa.binary()) for _ in HEAD]
        yield pa.RecordBatch.from_arrays([pa.array([grp[own[a]]]), pa.array([rows.tobytes()]), pa.array([counts.astype(np.int64).tobytes()]), *nulls], names)


def _gathered(batches: Iterator[pa.RecordBatch], head_at: int) -> Iterator[tuple[int, list, list]]:
    """(group, its head's columns, its parts' columns) of what was dealt by group."""
    heads: dict[int, list] = {}
    parts: dict[int, list] = {}
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for i, grp in enumerate(cols[0]):
            if cols[head_at][i] is not None:
                heads[grp] = [c[i] for c in cols[head_at:]]
            else:
                parts.setdefault(grp, []).append([c[i] for c in cols[1:head_at]])
    for grp in list(heads):
        yield grp, heads.pop(grp), parts.pop(grp, [])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks' counts of a group to one row a document."""
    for _, head, parts in _gathered(batches, 3):
        rids, sizes, counts, f1, f2 = (np.frombuffer(x, np.int64) for x in head)
        total = counts.copy()
        for rows, own in parts:
            total[np.frombuffer(rows, np.uint32)] += np.frombuffer(own, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rids, sizes, total, f1, f2)], ["rid", "n", "count", "f1", "f2"])


def partner_counts(rows: DataFrame, sets, blocks: int, pct: int) -> DataFrame:
    """(rid, n, count, f1, f2) of every row of (rid, text)."""
    packed = rows.mapInArrow(*freed(_ship(sets, blocks, pct), f"block int, grp long, data binary, {HEADS}"))
    counted = packed.repartition(blocks, "block").mapInArrow(*freed(_count, COUNTS))
    return counted.repartition(blocks, "grp").mapInArrow(*freed(_sum, "rid long, n long, count long, f1 long, f2 long"))


def can_link(pct: int):
    """Sound survival test: enough prefix shingles that some other row has."""
    least = F.ceil(F.col("n") * pct / 100)
    return (F.col("n") > 0) & (F.col("count") >= F.greatest(F.lit(1), F.floor(least / 10)))


POSTING = np.dtype([("key", np.uint64), ("row", np.uint32), ("count", np.uint32)])


def _ship_sets(blocks: int):
    """(rid, n, vals) to packed postings by block of the key.  A key of several rows of the
    group is one record with their number; its rows stay with the group's head."""
    names = ["block", "grp", "data", "rids", "sizes", "local"]

    def flush(rids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        grp, sizes = rids[0], np.array([len(p) for p in parts], np.int64)
        key = np.concatenate(parts)
        row = np.repeat(np.arange(len(rids), dtype=np.uint32), sizes)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        start, end = _cut(key)
        size = end - start
        many = np.repeat(size > 1, size)
        local = np.empty(int(many.sum()), POSTING)
        local["key"], local["row"], local["count"] = key[many], row[many], 0
        rec = np.empty(len(start), POSTING)
        rec["key"], rec["row"], rec["count"] = key[start], np.where(size > 1, LOCAL, row[start]), size
        block = (mix64(rec["key"]) % np.uint64(blocks)).astype(np.int64)
        by = np.argsort(block, kind="stable")
        rec, block = rec[by], block[by]
        begin, stop = _cut(block)
        m = len(begin)
        cols = [
            pa.array([*block[begin].tolist(), grp % blocks], pa.int32()),
            pa.array([grp] * (m + 1), pa.int64()),
            pa.array([*(rec[a:z].tobytes() for a, z in zip(begin, stop, strict=True)), b""], pa.binary()),
            *(pa.array([None] * m + [x.tobytes()], pa.binary()) for x in (np.array(rids, np.int64), sizes, local)),
        ]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, parts, total = [], [], 0
        for b in batches:
            col = b.column(2)
            offs, flat = np.asarray(col.offsets), np.asarray(col.values).view(np.uint64)
            for i, rid in enumerate(b.column(0).to_pylist()):
                rids.append(rid)
                parts.append(flat[offs[i] : offs[i + 1]])
                total += len(parts[-1])
                if total >= FLUSH:
                    yield flush(rids, parts)
                    rids, parts, total = [], [], 0
        if rids:
            yield flush(rids, parts)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed postings to the same ones with document frequencies, of keys of two documents
    or more, back to their groups."""
    names = ["grp", "data", "rids", "sizes", "local"]
    recs: list[np.ndarray] = []
    grps: list[np.ndarray] = []
    for b in batches:
        grp = b.column(1).to_pylist()
        for i, data in enumerate(b.column(2)):
            if d := data.as_py():
                recs.append(np.frombuffer(d, POSTING))
                grps.append(np.full(len(recs[-1]), grp[i], np.int64))
            elif b.column(3)[i].is_valid:
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, 1), pa.nulls(1, pa.binary()), *(c.slice(i, 1) for c in b.columns[3:])], names)
    if not recs:
        return
    rec, grp = np.concatenate(recs), np.concatenate(grps)
    recs.clear()
    grps.clear()
    order = np.argsort(rec["key"], kind="stable")
    rec, grp = rec[order], grp[order]
    start, end = _cut(rec["key"])
    df = np.add.reduceat(rec["count"].astype(np.int64), start)
    rec["count"] = np.minimum(np.repeat(df, end - start), (1 << 32) - 1)
    keep = rec["count"] > 1
    rec, grp = rec[keep], grp[keep]
    order = np.argsort(grp, kind="stable")
    rec, grp = rec[order], grp[order]
    for a, z in zip(*_cut(grp), strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([grp[a]]), pa.array([rec[a:z].tobytes()], pa.binary()), *(pa.nulls(1, pa.binary()) for _ in range(3))], names)


#: Longs of a sketch: each shingle that other documents have sets one of their bits.
SKETCH = 16
SKETCHES = [f"s{i}" for i in range(SKETCH)]


def _assemble(pct: int):
    """A group's postings to (rid, n, own, sketch, lists, score, prefix) of each document that
    has a shingle of others: ``own`` are its shingles of no other, ``lists`` its part in the number
    of lists, ``prefix`` the shared ones among its rarest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, head, parts in _gathered(batches, 2):
            rids, sizes = (np.frombuffer(x, np.int64) for x in head[:2])
            local = np.frombuffer(head[2], POSTING)
            rec = np.concatenate([np.frombuffer(x, POSTING) for (x,) in parts]) if parts else local[:0]
            shared = rec["row"] == LOCAL
            known = rec[shared][np.argsort(rec["key"][shared])]
            mine = local.copy()
            mine["count"] = known["count"][np.searchsorted(known["key"], mine["key"])] if len(mine) else 0
            rec = np.concatenate([rec[~shared], mine])
            rec = rec[np.lexsort((rec["key"], rec["count"], rec["row"]))]
            begin, end = _cut(rec["row"])
            if not len(begin):
                continue
            row = rec["row"][begin].astype(np.int64)
            n, m = sizes[row], end - begin
            own = n - m
            need = np.maximum(n + (-n * pct // 100) + 1 - own, 0)
            bits = np.zeros((len(row), 64 * SKETCH), np.uint8)
            bits[np.repeat(np.arange(len(row)), m), (mix64(rec["key"] + MIX[45]) >> np.uint64(40)).astype(np.int64) % (64 * SKETCH)] = 1
            bits = np.packbits(bits, axis=1).view(np.int64)
            lists = np.add.reduceat(1 / rec["count"], begin)
            score = np.add.reduceat(rec["count"].astype(float), begin) / n
            take = np.minimum(need, m)
            first = np.arange(len(rec)) - np.repeat(begin, m) < np.repeat(take, m)
            offs = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offs), pa.array(rec["key"][first].view(np.int64)))
            cols = [rids[row], n, own, *bits.T, lists, score]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in cols), prefix], ["rid", "n", "own", *SKETCHES, "lists", "score", "prefix"])

    return run


def near_shape(pct: int):
    """Whether two (n, own, sketch) can be at ``pct``; never false for a pair that is.

    At similarity p at most (a + b)(1 - p) / (1 + p) shingles are in one set only.  A shingle of
    no other document is such a one, and a bit that only one sketch has stands for another."""

    def test(a, b):
        odd = sum((F.bit_count(a[x].bitwiseXOR(b[x])) for x in SKETCHES), a["own"] + b["own"])
        fits = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * pct
        return fits & (odd * (100 + pct) <= (a["n"] + b["n"]) * (100 - pct))

    return test


def _sets_table(k: int):
    """(rid, text) to (rid, n, vals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, found in _sets_of_text(k)(b):
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                offs = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                vals = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(found)), pa.array(np.diff(offs).astype(np.int64)), vals], ["rid", "n", "vals"])

    return run


def subset_sizes(n: int, pct: int) -> list[int]:
    """The overlaps that a set of n needs with each similar size."""
    sizes = range(least_overlap(n, pct), n * 100 // pct + 1)
    return sorted({ceil(pct * (n + m) / (100 + pct)) for m in sizes if ceil(pct * (n + m) / (100 + pct)) <= min(n, m)})


def light_cost(n: int, pct: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, pct))


def light_boundary(mean_list: float, pct: int) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning
    the prefix's inverted lists (of ``mean_list`` members) and verifying."""
    n = 0
    while light_cost(n + 1, pct) <= (n + 2 - least_overlap(n + 1, pct)) * (1 + mean_list) + (n + 1) * mean_list:
        n += 1
    return n


def _subsets(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = [], []
            for rid, n, vals in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                v = np.sort(np.array(vals, np.int64).view(np.uint64))
                for c in subset_sizes(n, pct):
                    pick = np.array(list(combinations(range(n), c)))
                    code = mix64((v[pick] * MIX[1 : 1 + c]).sum(axis=1, dtype=np.uint64) + MIX[55:56] * np.uint64(c))
                    keys += code.view(np.int64).tolist()
                    ids += [rid] * len(pick)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], ["key", "id"])

    return run


def _linked(src: DataFrame, scratch: Scratch, final: Scratch, k: int, pct: int) -> tuple[DataFrame, DataFrame]:
    """src: (rid, id, t).  (rid, component_id, is_first) of the rows that are linked, and
    (rid, n, ...) of every row."""
    blocks = block_count(src)
    counts = final.table(partner_counts(src.select("rid", "t"), _sets_of_text(k), blocks, pct))
    may = scratch.table(counts.where(can_link(pct)).select("rid", "n", "f1", "f2"))
    classes = scratch.table(may.groupBy("f1", "f2", "n").agg(F.min("rid").alias("rep")))
    reps = scratch.table(src.select("rid", "t").join(classes.select(F.col("rep").alias("rid")).hint("merge"), "rid", "left_semi").mapInArrow(*freed(_sets_table(k), "rid long, n long, vals array<long>")))

    packed = reps.mapInArrow(*freed(_ship_sets(blocks), "block int, grp long, data binary, rids binary, sizes binary, local binary"))
    listed = packed.repartition(blocks, "block").mapInArrow(*freed(_frequencies, "grp long, data binary, rids binary, sizes binary, local binary"))
    longs = ", ".join(f"{x} long" for x in SKETCHES)
    shaped = listed.repartition(blocks, "grp").mapInArrow(*freed(_assemble(pct), f"rid long, n long, own long, {longs}, lists double, score double, prefix array<long>"))
    shaped = scratch.table(shaped)
    stat = shaped.agg(F.sum("lists").alias("x"), F.sum(F.col("n") - F.col("own")).alias("m")).first()
    bound = light_boundary((stat["m"] or 0) / (stat["x"] or 1), pct)
    light = reps.where(F.col("n").between(1, bound)).mapInArrow(*freed(_subsets(pct), "key long, id long")).distinct().withColumn("score", F.lit(0.0))
    heavy = shaped.where(F.col("n") >= least_overlap(bound + 1, pct)).select(F.explode("prefix").alias("key"), F.col("rid").alias("id"), "score")

    def verify(pairs: DataFrame) -> DataFrame:
        a = reps.select(F.col("rid").alias("a"), F.col("vals").alias("va"))
        b = reps.select(F.col("rid").alias("b"), F.col("vals").alias("vb"))
        both = pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("va", "vb")))
        return both.where(F.col("i") * 100 >= (F.size("va") + F.size("vb") - F.col("i")) * pct).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    shapes = shaped.select(F.col("rid").alias("id"), F.struct("n", "own", *SKETCHES).alias("n"))
    labels = link_components(light.unionByName(heavy), shapes, verify, near_shape(pct), scratch)
    member = may.join(classes, ["f1", "f2", "n"]).select("rid", F.col("rep").alias("comp"))
    if labels is not None:
        member = member.join(labels.select(F.col("id").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("rid", F.coalesce("root", "comp").alias("comp"))
    # classes and components of one row need no id
    many = scratch.table(member.groupBy("comp").agg(F.count("*").alias("m")).where("m > 1").select("comp"))
    member = scratch.table(member.join(many, "comp"))
    member = scratch.table(src.select("rid", "id").join(member, "rid"))
    first = member.groupBy("comp").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull().alias("o"), "id", "rid")).alias("f"))
    first = scratch.table(first.select("comp", "component_id", F.col("f.rid").alias("first")))
    return final.table(member.join(first, "comp").select("rid", "component_id", (F.col("first") == F.col("rid")).alias("is_first"))), counts


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, pct: int = 75) -> DataFrame:
    """One row per row of ``docs``: __rid, id, n_shingles, component_id (smallest id
    reachable by links) and is_first (the one row of its component to keep)."""
    final = Scratch(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        src = with_row_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), final, "rid")
        member, counts = _linked(src, scratch, final, k, pct)
    ids = src.select("rid", "id").join(counts, "rid")
    return ids.join(member, "rid", "left").select(
        F.col("rid").alias("__rid"),
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("is_first", F.lit(True)).alias("is_first"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, pct: int = 75) -> DataFrame:
    """``docs`` with one row of each component (its smallest id); all columns stay."""
    final = Scratch(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        rows = with_row_id(docs, final)
        src = rows.select(F.col("__rid").alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        member, _ = _linked(src, scratch, final, k, pct)
    gone = member.where(~F.col("is_first")).select(F.col("rid").alias("__rid"))
    return rows.join(gone, "__rid", "left_anti").drop("__rid")
