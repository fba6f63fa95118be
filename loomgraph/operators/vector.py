"""Cosine similarity search (ids L1, J14, P3, X18).  Exact, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def top_k(vectors: DataFrame, query: list[float], k: int = 60, threshold: float = 0.2, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The k most similar rows at or above the threshold, with ``sim`` (6 digits decide ties by id).

    A map-side top-k: each task keeps k rows, so the full scan shuffles almost nothing."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = F.round(cosine(F.col(vec_col), q), 6)
    return vectors.withColumn("sim", sim).where(F.col("sim") >= threshold).orderBy(F.desc("sim"), F.asc(id_col)).limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.2, id_col: str = "id", vec_col: str = "embedding", block: int = 256) -> DataFrame:
    """Top k for each row of a stated query set (query_id, query), without a cross join.

    The set goes through in blocks of ``block`` literal rows, each one scan of the vectors with
    a top k in every task before its small shuffle; the driver holds one block at a time."""
    kind = queries.schema["query_id"].dataType
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc(id_col))
    out, rows = None, []

    def scan(rows: list) -> DataFrame:
        known = F.array(*[F.struct(F.lit(r["query_id"]).cast(kind).alias("query_id"), F.array(*[F.lit(float(x)) for x in r["query"]]).alias("query")) for r in rows])
        hits = vectors.select(id_col, vec_col, F.explode(known).alias("q"))
        hits = hits.select(F.col("q.query_id").alias("query_id"), id_col, F.round(cosine(F.col(vec_col), F.col("q.query")), 6).alias("sim")).where(F.col("sim") >= threshold)
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    for r in queries.select("query_id", "query").toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            out, rows = scan(rows) if out is None else out.unionByName(scan(rows)), []
    if rows:
        out = scan(rows) if out is None else out.unionByName(scan(rows))
    if out is None:  # no question, no hit
        none = vectors.limit(0)
        out = none.select(F.lit(None).cast(kind).alias("query_id"), id_col, F.lit(0.0).alias("sim"), F.lit(0).alias("rank"))
    return out


def upsert_vectors(stored: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """New vectors replace those of the same id."""
    return stored.join(rows.select(id_col), id_col, "left_anti").unionByName(rows.dropDuplicates([id_col]))
