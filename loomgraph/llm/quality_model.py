"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Every text gets a vector of document statistics.  Standardised, they are mapped
through random cosine features, which approximate a Gaussian kernel.  The normal
equations of ridge regression are summed within each partition, then over a few
partitions, then on the driver: what is sent has the size of the feature matrix
squared, whatever the corpus.  Scores are calibrated by isotonic regression over
a fixed grid of raw scores (pool adjacent violators), on a fold of the labelled
rows that the ridge did not see.

Edge cases: null and empty texts have the statistics of an empty text and are
scored like any other.  Several labels of one id count as their mean.  With no
label at all every score is 0.5.  Null ids are scored and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MIX, SPACE, Scratch, freed, mix64, prefix_hash, slices, span_hash, text_bytes, word_spans
from .language_id import train_rows

#: Short common words of four languages.
COMMON = (
    "the of and to in a is that it for de la le et les des en un du que der die und den von zu das mit sich nicht "
    "el y los se del las por con una para on was be with as by are from this at".split()
)
GRID = 1000
CLASS = np.full(256, 5, np.int64)
CLASS[48:58] = 2
CLASS[65:91] = 1
CLASS[97:123] = 0
CLASS[[0x20, 9, 10, 11, 12, 13]] = 3
CLASS[[ord(c) for c in ".,;:'\"?-"]] = 4
CLASS[128:] = 6
NAMES = 22


def common_codes() -> np.ndarray:
    data = np.frombuffer(" ".join(sorted(set(COMMON))).encode(), np.uint8)
    start, end, _ = word_spans(data, np.array([0, len(data)]))
    return np.sort(span_hash(prefix_hash(data), start, end))


def statistics(data: np.ndarray, offs: np.ndarray, common: np.ndarray) -> np.ndarray:
    """(rows, NAMES) statistics of each text, shares mostly."""
    rows = len(offs) - 1
    size = np.diff(offs)
    of = np.repeat(np.arange(rows), size)
    cls = np.bincount(of * 7 + CLASS[data], minlength=rows * 7).reshape(rows, 7)
    start, end, row = word_spans(data, offs)
    h = span_hash(prefix_hash(LOWER[data]), start, end)
    length = (end - start).astype(float)
    n = np.bincount(row, minlength=rows)
    total = np.bincount(row, length, minlength=rows)
    square = np.bincount(row, length**2, minlength=rows)
    one = np.maximum(n, 1)
    mean = total / one
    hit = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
    mark = CLASS[data[start]] == 5 if len(start) else np.zeros(0, bool)
    out = np.zeros((rows, NAMES))
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.log1p(size)
    out[:, 2:9] = cls / np.maximum(size, 1)[:, None]
    out[:, 9] = mean
    out[:, 10] = np.sqrt(np.maximum(square / one - mean**2, 0))
    out[:, 11] = np.bincount(row, hit, minlength=rows) / one
    out[:, 12] = np.bincount(row, mark, minlength=rows) / one
    at = np.searchsorted(row, np.arange(rows + 1))
    gram = mix64(h[: max(len(h) - 2, 0)] * MIX[1] + h[1 : max(len(h) - 1, 1)][: max(len(h) - 2, 0)] * MIX[2] + h[2:] * MIX[3]) if len(h) > 2 else h[:0]
    nl = data == 10
    out[:, 13] = np.log1p(np.bincount(of[nl], minlength=rows))
    for r in range(rows):
        a, b = at[r], at[r + 1]
        if b > a:
            w = np.sort(h[a:b])
            runs = np.diff(np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]])))
            out[r, 14] = len(runs) / (b - a)
            out[r, 15] = runs.max() / (b - a)
            p = runs / (b - a)
            out[r, 16] = -(p * np.log(p)).sum() / max(np.log(b - a), 1e-9) if b - a > 1 else 0
            out[r, 17] = (h[a + 1 : b] == h[a : b - 1]).sum() / (b - a)
        if b - a > 3:
            g = np.sort(gram[a : b - 2])
            out[r, 18] = (g[1:] == g[:-1]).sum() / len(g)
    out[:, 19] = np.bincount(row, end - start == 1, minlength=rows) / one
    out[:, 20] = np.bincount(row, length > 15, minlength=rows) / one
    tail = CLASS[data[end - 1]] == 5 if len(end) else np.zeros(0, bool)
    out[:, 21] = np.bincount(row, tail, minlength=rows) / one
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common = common_codes()
    for b in batches:
        data, offs = text_bytes(b.column(b.num_columns - 1))
        for lo, hi in slices(offs):
            x = statistics(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], common).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), NAMES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), flat], ["rid", "id", "x"])


def matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), -1).astype(float)


class Fourier:
    """Standardisation and ``dim`` random cosine features of a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, dev: np.ndarray, dim: int, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.dev = mean, np.where(dev > 1e-9, dev, 1)
        self.w = rng.standard_normal((len(mean), dim)) / np.sqrt(len(mean))
        self.shift = rng.uniform(0, 2 * np.pi, dim)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.dev, -8, 8)
        f = np.cos(z @ self.w + self.shift) * np.sqrt(2 / len(self.shift))
        return np.concatenate([f, np.ones((len(x), 1))], axis=1)


def _equations(fourier: Fourier):
    """(x, y) rows to one packed [A | b] of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            if b.num_rows:
                f = fourier(matrix(b.column(0)))
                total = total + f.T @ np.concatenate([f, np.asarray(b.column(1)).astype(float)[:, None]], axis=1)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for m in b.column(0):
            v = np.frombuffer(m.as_py())
            total = v if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted x: knots and their fitted values."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        pools.append([a, a, b, c])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            hi = pools.pop()
            lo = pools.pop()
            m = lo[3] + hi[3]
            pools.append([lo[0], hi[1], (lo[2] * lo[3] + hi[2] * hi[3]) / m, m])
    xs = [v for p in pools for v in ((p[0], p[1]) if p[1] > p[0] else (p[0],))]
    ys = [p[2] for p in pools for _ in range(2 if p[1] > p[0] else 1)]
    return np.array(xs), np.array(ys)


def _scores(fourier: Fourier, beta: np.ndarray, knots=None):
    """Rows (rid, id, x) to raw scores in 0..1, calibrated if there are knots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.clip(fourier(matrix(b.column(2))) @ beta, 0, 1) if b.num_rows else np.zeros(0)
            if knots is not None:
                s = np.clip(np.interp(s, *knots), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["rid", "id", "s"])

    return run


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    dim: int = 256,
    ridge: float = 1e-4,
) -> DataFrame:
    """id, held_out, score and predicted for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # stored with the statistics, so one numbering holds
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    stats = scratch.table(src.mapInArrow(*freed(_stats, f"rid long, id {kind}, x array<float>")))
    m = stats.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(NAMES)], *[F.stddev_pop(F.col("x")[i]).alias(f"d{i}") for i in range(NAMES)]).first()
    fourier = Fourier(np.array([m[f"m{i}"] or 0.0 for i in range(NAMES)]), np.array([m[f"d{i}"] or 0.0 for i in range(NAMES)]), dim)
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("y"))
    known = scratch.table(stats.where(train_rows(F.col("id"))).join(y, "id"))
    apart = (F.crc32(F.col("id").cast("string")) / 3).cast("long") % 5 == 0
    fit, calibrate = known.where(~apart), known.where(apart)
    if fit.isEmpty() or calibrate.isEmpty():
        fit = calibrate = known
    parts = fit.select("x", "y").mapInArrow(*freed(_equations(fourier), "m binary"))
    # a tree of sums: no task adds more matrices than the square root of their number
    width = max(1, isqrt(fit.rdd.getNumPartitions()))
    parts = parts.repartition(width).mapInArrow(*freed(_add, "m binary")).repartition(max(1, isqrt(width))).mapInArrow(*freed(_add, "m binary")).collect()
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    if not parts:
        return stats.select(F.col("id").alias(id_col), held, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    total = sum(np.frombuffer(r["m"]) for r in parts).reshape(dim + 1, dim + 2)
    n = total[dim, dim]
    reg = np.eye(dim + 1) * ridge * n
    reg[dim, dim] = 0
    beta = np.linalg.solve(total[:, :-1] + reg + 1e-9 * np.eye(dim + 1), total[:, -1])
    raw = calibrate.select("rid", "id", "x").mapInArrow(*freed(_scores(fourier, beta), f"rid long, id {kind}, s double")).join(y, "id")
    grid = raw.groupBy(F.round(F.col("s") * GRID).cast("int").alias("g")).agg(F.avg("y").alias("y"), F.count("*").alias("w")).orderBy("g").collect()
    knots = isotonic(np.array([r["g"] / GRID for r in grid]), np.array([r["y"] for r in grid]), np.array([float(r["w"]) for r in grid]))
    scratch.drop(known)
    out = stats.mapInArrow(*freed(_scores(fourier, beta, knots), f"rid long, id {kind}, s double"))
    return out.select(F.col("id").alias(id_col), held, F.col("s").alias("score"), (F.col("s") >= 0.5).cast("int").alias("predicted"))
