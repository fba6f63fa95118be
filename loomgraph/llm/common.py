"""Shared plumbing: scratch tables, row ids, Arrow text views, block shuffles.

Large intermediates are Parquet tables under ``spark.checkpoint.dir`` (a folder
all executors and the driver share) or reliable checkpoints in it, so a lost
executor costs a re-read and never the data.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles at a time (numpy temporaries are
#: about 40 times this).
SLICE_BYTES = 1 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers on this host find the package from where the driver has it."""
    here, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; one of this machine only in local mode, where none is set."""
    importable(spark)
    sc = spark.sparkContext
    here = sc._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (here.get() if here.isDefined() else None)
    if not path:
        if not (sc.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        path = tempfile.mkdtemp(prefix="loomgraph-")
    if not here.isDefined():
        sc.setCheckpointDir(path)
    return path


class Scratch:
    """Parquet tables in the shared folder; as a context manager they go with the block,
    however it ends.  Tables that a lazy result still reads belong to one that is not entered."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failed) -> None:
        self.drop()

    def table(self, df: DataFrame, dictionary: bool = True) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage and survives lost executors.  Dictionaries
        only cost time where hardly a value occurs twice."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
        self.release()
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now, not when the
        driver next happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, table: DataFrame | None = None) -> None:
        """Delete one table, or all."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root if table is None else table.scratch_path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is Parquet files with nothing but projections and filters on top."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().toString() == "Parquet"


def with_row_id(df: DataFrame, scratch: Scratch, name: str = "__rid") -> DataFrame:
    """``df`` with a key of each row that holds for duplicate and null ids alike.

    The key is made of the row's file and its place in that file, so every scan gives
    the same keys, however files are packed into partitions.  What is no plain scan
    is stored in ``scratch`` first, which must outlive the result.  A few hash
    functions are tried until no two files share the upper bits.
    """
    if not is_scan(df):
        df = scratch.table(df)
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    salt = 0
    files = df.select(path.alias("p"), row.alias("r")).groupBy("p").agg(F.max("r").alias("r"))
    while True:
        got = files.select("r", *[F.xxhash64("p", F.lit(salt + i)).alias(f"h{i}") for i in range(8)]).collect()
        bits = max([1, *(int(x["r"]).bit_length() for x in got)])
        fine = [i for i in range(8) if len({(x[f"h{i}"] & ((1 << 64) - 1)) >> (bits + 1) for x in got}) == len(got)]
        if fine:
            break
        salt += 8
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(path, F.lit(salt + fine[0])), bits + 1), bits)
    return df.select("*", high.bitwiseOR(row).alias(name))


def release_memory() -> None:
    """Gives a Python worker's freed memory back: workers wait for the next task beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def freed(run: Callable, schema) -> tuple[Callable, object]:
    """The arguments of mapInArrow, for a function whose worker gives its memory back at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return whole, schema


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row."""
    return F.transform(F.array(value), body)[0]


def input_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate for ``df``; no job is run."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return min(int(str(size)), 1 << 50)


def block_count(df: DataFrame, per_block: int = 16 << 20) -> int:
    """Shuffle blocks in proportion to the input, so a block stays of one size."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-input_bytes(df) // per_block))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Zero-copy view of a string column: UTF-8 bytes and row offsets (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes and at most ``rows`` rows each; a longer row is a
    range of its own."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        to = min(max(to, at + 1), at + rows, n)
        yield at, to
        at = to


# --------------------------------------------------------------- hashing
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept, grown by doubling)."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 18)
        out = []
        for b in (BASE, BASE_INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] == hash of data[i:j] times BASE**i."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * pw[: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end], by content alone."""
    _, inv = powers(len(h))
    return mix64((h[end] - h[start]) * inv[start] + (end - start).astype(np.uint64) * MIX[0])


#: A polynomial hash modulo 2**64 can be fooled by long strings of a certain making; spans
#: beyond this size get another one.
LONG = 256


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word data[start:end]."""
    out = span_hash(prefix_hash(data), start, end)
    for i in np.flatnonzero(end - start > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(spans, 2): a 128-bit digest of each data[start:end] as two 64-bit integers."""
    raw, of = data.tobytes(), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([of(raw[a:z]) for a, z in zip(start.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row it is in; words end with their row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~sep[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def word_shingles(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles (A-Z lower-cased).

    A row of 1 to k-1 words has its whole sequence as one shingle; no word, none.
    """
    start, end, row = word_spans(data, offs)
    h = word_hash(LOWER[data], start, end)
    n, rows = len(h), len(offs) - 1
    at = np.searchsorted(row, np.arange(rows + 1))
    full = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        full += h[j : j + len(full)] * MIX[1 + j]
    full = mix64(full)
    out = []
    for r in range(rows):
        a, b = int(at[r]), int(at[r + 1])
        if b - a >= k:
            s = np.sort(full[a : b - k + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            w = h[a:b]
            out.append(mix64((w * MIX[1 : 1 + b - a]).sum(dtype=np.uint64, keepdims=True) + MIX[60:61] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ------------------------------------------------- connected components
def connected_components(edges: DataFrame, scratch: Scratch, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, comp): the smallest id each node reaches, over the edges' nodes.

    Each round hooks every node to its smallest neighbour, jumps one pointer, and
    contracts the edges, so the graph shrinks by a constant factor a round; the
    smallest node of a component never hooks away.  The maps of all rounds are
    composed at the end.  Minima are combined before their shuffle, and joins by a
    hub read plain tables on both sides, which lets Spark split its rows.
    """
    src, dst = F.col(a).cast("long"), F.col(b).cast("long")
    e = scratch.table(edges.where(src != dst).select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).distinct())
    maps: list[DataFrame] = []
    while not maps or not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = scratch.table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        jump = hook.select(F.col("u").alias("m"), F.col("m").alias("to"))
        maps.append(scratch.table(hook.join(jump, "m").select("u", F.col("to").alias("m"))))
        x, y = maps[-1].select("u", F.col("m").alias("x")), maps[-1].select(F.col("u").alias("v"), F.col("m").alias("y"))
        rest = e.join(x, "u").join(y, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        after = scratch.table(rest)
        scratch.drop(hook)
        scratch.drop(e)
        e = after
    comp = maps.pop()
    for m in reversed(maps):
        up = comp.select(F.col("u").alias("m"), F.col("m").alias("to"))
        comp = m.join(up, "m", "left").select("u", F.coalesce("to", "m").alias("m"))
    return comp.select(F.col("u").alias("id"), F.col("m").alias("comp"))
