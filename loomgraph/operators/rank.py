"""Ordered operations: token budgets, first-wins, stable ranks, pages (ids W1-W6, L2-L6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def token_budget(df: DataFrame, text_col: str, budget: int, order: list, by: list | None = None) -> DataFrame:
    """The longest prefix, in ``order``, whose token counts sum to at most ``budget``.

    Of rows that have a token at most ``budget`` can stay.  The first of each group are taken
    where the rows are, before the shuffle; the window of sums then sees few rows of any group,
    however large it is."""
    own = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    n = T.token_count(F.col(text_col))
    rows = df.withColumn("__n", n)
    first = rows.where("__n > 0").withColumn("__r", F.row_number().over(own)).where(F.col("__r") <= max(budget, 0) + 1).drop("__r")
    total = F.sum("__n").over(own.rowsBetween(Window.unboundedPreceding, 0))
    out = first.unionByName(rows.where("__n = 0")).withColumn("__sum", total)
    return out.where((F.col("__sum") <= budget) & F.lit(budget > 0)).drop("__sum", "__n")


def first_wins(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key; null keys are dropped."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ranked(df: DataFrame, name: str, order: list, start: int = 0) -> DataFrame:
    """Positions 0, 1, ... of a small section in ``order``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1 + start)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of rows; a top-k sort, never a full one-partition sort."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, size: int) -> DataFrame:
    """total rows and pages."""
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))


def edge_order(arity: str = "arity", weight: str = "weight", tie: str = "edge_key") -> list[Column]:
    """Hyperedges by members, then weight; ties by key."""
    return [F.desc(arity), F.desc(weight), F.asc(tie)]


def sliding_join(df: DataFrame, text_col: str, order: str, width: int = 3, sep: str = "", block: int = 4096) -> DataFrame:
    """Each row's text joined with those of the next ``width - 1`` rows (full windows only).

    ``order`` must be consecutive integers.  Rows are dealt into blocks of ``block`` positions,
    and the first rows of a block are shared with the one before, so no task has all rows."""
    pos = F.col(order)
    mine = F.floor(pos / block)
    before = F.when((pos % block) < width - 1, mine - 1)
    rows = df.withColumn("__b", F.explode(F.array_compact(F.array(mine, before))))
    w = Window.partitionBy("__b").orderBy(order).rowsBetween(0, width - 1)
    out = rows.withColumn("__t", F.collect_list(text_col).over(w)).where((F.size("__t") == width) & (F.col("__b") == mine))
    return out.withColumn("reference", F.array_join("__t", sep)).drop("__t", "__b")


def distinct_first(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct values with the position where each first occurs."""
    return df.groupBy(key).agg(F.min(pos).alias(pos))
