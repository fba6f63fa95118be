"""Benchmark decontamination with one Aho-Corasick automaton.

Items and documents are normalised alike (A-Z lower-cased; words are runs of
letters, digits and non-ASCII characters).  Every window of ``window``
consecutive item words goes into one automaton, which reads each normalised
document once; hits are mapped back to code-point offsets of the original text.

The automaton's input is bounded: the distinct windows with their item ids are dealt
by hash into blocks of at most about ``block_bytes``; each block is one broadcast and
one narrow pass, and a further block's pass reads the stored result of the last.  The
ids of a window that very many items have are dealt in parts of ``PART`` ids.

Edge cases: null or empty text, or text without words: n_words 0 and clean.
Null or word-less items match nothing.  Items shorter than a window are one
window.  Repeated items all count.  An item without an id hits words but is in no list
and no number of items.  Extra columns pass through untouched; ``__words``, ``__hits``,
``__items`` and ``__spans`` are reserved names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, freed, shared_dir

TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
IS_WORD = np.array([c != 32 for c in TABLE])
#: Ids of a window that go into one block.
PART = 10_000
COLUMNS = ("n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated")


def item_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(window, items): every distinct window with the ids (as text) of its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wins = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = (t or "").encode().translate(TABLE).split()
                for k in range(max(len(w) - window, 0) + 1 if w else 0):
                    ids.append(i)
                    wins.append(b" ".join(w[k : k + window]).decode("latin-1"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.string())], ["item", "window"])

    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).mapInArrow(*freed(run, "item string, window string"))
    rows = rows.distinct()
    # (window, part): a window's ids are never one unbounded list
    parts = rows.groupBy("window").agg(F.ceil(F.count("*") / PART).alias("parts"))
    part = F.pmod(F.xxhash64(F.coalesce("item", F.lit(""))), F.col("parts")).alias("part")
    return rows.join(parts, "window").groupBy("window", part).agg(F.collect_list("item").alias("items"))


def _automaton(rows: list[tuple[str, list[str]]]):
    auto, known = ahocorasick.Automaton(), {}
    for win, items in rows:
        known.setdefault(win, []).extend(items)
    for win, items in known.items():
        auto.add_word(f" {win} ", (win.count(" ") + 1, items))
    auto.make_automaton()
    return auto


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _offsets(raw: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Word ranges to code-point ranges of the original text."""
    data = np.frombuffer(raw, np.uint8)
    word = np.concatenate([[False], IS_WORD[data], [False]])
    step = np.diff(word.astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [{"start": int(chars[start[a]]), "end": int(chars[end[b - 1]])} for a, b in spans]


def _pass(rows, known: bool, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = None
        for b in batches:
            if auto is None and rows.value:
                auto = _automaton(rows.value)
            texts = b.column(b.schema.get_field_index(text_col))
            n_words, hits, found = [], [], []
            old_w = b.column(b.schema.get_field_index("__hits")).to_pylist() if known else None
            old_i = b.column(b.schema.get_field_index("__items")).to_pylist() if known else None
            for k in range(b.num_rows):
                t = texts[k].as_py()
                s = b" ".join((t or "").encode().translate(TABLE).split()).decode("latin-1")
                n_words.append(s.count(" ") + 1 if s else 0)
                got, ids, ends = [], set(), None
                if auto is not None and s:
                    padded = f" {s} "
                    for end, (n, items) in auto.iter(padded):
                        if ends is None:
                            ends = np.flatnonzero(np.frombuffer(padded.encode("latin-1"), np.uint8) == 32)
                        last = int(np.searchsorted(ends, end))
                        got.append((last - n, last))
                        ids.update(items)
                if known:
                    got += [(x["a"], x["b"]) for x in old_w[k]]
                    ids.update(old_i[k])
                hits.append([{"a": x, "b": y} for x, y in _merge(got)])
                found.append(sorted(ids))
            pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            cols = {f.name: b.column(i) for i, f in enumerate(b.schema) if f.name not in ("__words", "__hits", "__items")}
            cols |= {"__words": pa.array(n_words, pa.int64()), "__hits": pa.array(hits, pair), "__items": pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def _spans(text_col: str):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column(b.schema.get_field_index("__hits")).to_pylist()
            text = b.column(b.schema.get_field_index(text_col))
            spans = [_offsets(text[k].as_py().encode(), [(x["a"], x["b"]) for x in h]) if h else [] for k, h in enumerate(hits)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], [*b.schema.names, "__spans"])

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 4 << 20,
    spans: bool = True,
) -> DataFrame:
    """``docs`` plus n_words, n_hit (words inside an occurring window), n_items,
    item_ids (sorted as strings), spans (code-point ranges; if asked for) and
    contaminated.  Columns of ``docs`` with these names are replaced."""
    spark = docs.sparkSession
    shared_dir(spark)
    wins = item_windows(benchmark, window, item_col, item_text_col)
    scratch = Scratch(spark)
    wins = scratch.table(wins)
    weight = F.length("window") + F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 8)
    size = wins.agg(F.sum(weight).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    wins = wins.withColumn("block", F.pmod(F.xxhash64("window", "part"), F.lit(blocks)))
    keep = [c for c in docs.columns if c not in COLUMNS]
    out = docs.select(*keep)
    base = out.schema
    schema = f"{base.simpleString()[7:-1]},__words:bigint,__hits:array<struct<a:bigint,b:bigint>>,__items:array<string>"
    struct = spark.createDataFrame([], f"struct<{schema}>").schema
    for k in range(blocks):
        part = wins.where(F.col("block") == k)
        rows = spark.sparkContext.broadcast([(r["window"], r["items"]) for r in part.toLocalIterator()])
        out = out.mapInArrow(*freed(_pass(rows, k > 0, text_col), struct))
        if k + 1 < blocks:
            out = scratch.table(out)
    extra = []
    if spans:
        full = spark.createDataFrame([], f"struct<{schema},__spans:array<struct<start:bigint,end:bigint>>>").schema
        out = out.mapInArrow(*freed(_spans(text_col), full))
        extra = [F.col("__spans").alias("spans")]
    hit = F.aggregate("__hits", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select(
        *keep,
        F.col("__words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.col("__items").alias("item_ids"),
        *extra,
        (F.size("__hits") > 0).alias("contaminated"),
    )
