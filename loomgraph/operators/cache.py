"""Response cache and call plumbing (ids N1, N3-N6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def args_hash(model: Column, *inputs: Column) -> Column:
    """Identity of a call: model and every input."""
    return F.md5(F.to_json(F.array(model.cast("string"), *[i.cast("string") for i in inputs])))


def lookup(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """Calls (args_hash, ...) with what the cache returned, null on a miss."""
    return calls.join(cache.select("args_hash", F.col("return").alias("cached")), "args_hash", "left")


def answer(calls: DataFrame, cache: DataFrame, model: str, llm: Callable[[str], str | None], retries: int = 3, pause: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(answered calls, new cache rows).  Only misses, one of each hash, reach the model; a failed
    call is tried again after ``pause`` seconds, then twice as long."""
    found = lookup(calls, cache)
    misses = found.where("cached is null").dropDuplicates(["args_hash"]).select("args_hash", "prompt")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["prompt"]:
                for turn in range(retries):
                    try:
                        out.append(llm(p))
                        break
                    except Exception:
                        if turn + 1 == retries:
                            raise
                        time.sleep(pause * 2**turn)
            yield pd.DataFrame({"args_hash": b["args_hash"], "return": out})

    fresh = misses.mapInPandas(run, "args_hash string, return string").withColumn("model", F.lit(model))
    whole = cache.select("args_hash", "return").unionByName(fresh.select("args_hash", "return"))
    return calls.join(whole, "args_hash", "left"), fresh


def pieces(text: Column, size: int = 32) -> Column:
    """A cached answer in pieces, as a stream replays it."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def round_robin(seq: Column, n: int, first: int = 1) -> Column:
    """Which of n models serves the seq-th call (from 0)."""
    return F.pmod(seq + first, F.lit(n))
