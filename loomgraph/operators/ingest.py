"""Documents to chunks, with content ids and anti-join dedup (ids X1-X4, W7, P2, X19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def doc_ids(df: DataFrame, text_col: str = "content") -> DataFrame:
    """(doc_id, content) of stripped texts, one row each; the content is its identity."""
    s = T.strip(F.col(text_col))
    return df.where(F.col(text_col).isNotNull()).select(T.content_id(s, "doc-").alias("doc_id"), s.alias("content")).dropDuplicates(["doc_id"])


def new_rows(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the store yet."""
    return rows.join(stored.select(key), key, "left_anti")


def insert_if_absent(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The store with the new rows added; stored rows are never overwritten."""
    return stored.unionByName(new_rows(rows.dropDuplicates([key]), stored, key), allowMissingColumns=True)


def chunk_windows(docs: DataFrame, size: int = 1200, overlap: int = 100, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """Token windows: starts every ``size - overlap`` tokens, tails inside the last one kept."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    stride = size - overlap
    df = docs.withColumn("__t", T.tokens(F.col(text_col))).where(F.size("__t") > 0)
    start = F.sequence(F.lit(0), F.size("__t") - 1, F.lit(stride))
    df = df.select(F.col(id_col).alias("full_doc_id"), "__t", F.posexplode(start).alias("chunk_order_index", "__s"))
    content = T.strip(F.array_join(F.slice("__t", F.col("__s") + 1, F.lit(size)), " "))
    return df.select(
        T.content_id(content, "chunk-").alias("chunk_id"),
        "full_doc_id",
        "chunk_order_index",
        F.least(F.lit(size), F.size("__t") - F.col("__s")).alias("tokens"),
        content.alias("content"),
    )


def last_wins(chunks: DataFrame) -> DataFrame:
    """One row for each chunk id: equal windows belong to the last document that has them."""
    last = F.max_by(F.struct("full_doc_id", "chunk_order_index", "tokens", "content"), F.struct("full_doc_id", "chunk_order_index")).alias("x")
    return chunks.groupBy("chunk_id").agg(last).select("chunk_id", "x.*")
