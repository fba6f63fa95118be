"""Judge outputs to metrics (ids A14-A18, F12-F14, J16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T

#: The five scoring metrics, in the judge's order.
METRICS = ["comprehensiveness", "diversity", "empowerment", "logical", "readability"]


def score_means(judged: DataFrame, col: str = "answer") -> DataFrame:
    """Mean of each metric over complete answers, and the mean of means."""
    s = judged.select(T.scores(F.col(col)).alias("s")).where(F.size("s") == len(METRICS))
    means = s.agg(*[F.avg(F.col("s")[i]).alias(m) for i, m in enumerate(METRICS)])
    return means.withColumn("mean", sum((F.col(m) for m in METRICS), F.lit(0.0)) / len(METRICS))


def win_rates(judged: DataFrame, col: str = "answer", criteria: int = 8) -> DataFrame:
    """(criterion, rate): the share of "Answer 1" for each criterion; -1 is the mean of all."""
    w = judged.select(T.winners(F.col(col)).alias("w")).where(F.size("w") == criteria)
    each = w.select(F.posexplode("w").alias("criterion", "w")).groupBy("criterion").agg(F.avg((F.col("w") == "answer 1").cast("int")).alias("rate"))
    mean = each.agg(F.lit(-1).alias("criterion"), F.avg("rate").alias("rate"))
    return each.unionByName(mean)


def outcome_counts(results: DataFrame, ok: str = "ok") -> DataFrame:
    return results.agg(F.count_if(F.col(ok)).alias("n_ok"), F.count_if(~F.col(ok)).alias("n_failed"), F.count("*").alias("n_total"))


def zip_by_position(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Joins two lists by an explicit ordinal; unequal lengths leave nulls, never shifts."""
    return left.join(right, pos, "full")
