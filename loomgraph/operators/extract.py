"""Extraction output to typed records (ids X5-X11, P4-P5, F3-F4, F8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def extract(chunks: DataFrame, extractor: Callable[[str, str | None], str], max_gleaning: int = 1) -> DataFrame:
    """(chunk_id, output): runs an extractor over chunk contents, in Arrow batches.

    ``extractor(content, before)`` gets what earlier rounds returned (None at first);
    gleaned text is joined by the record delimiter so that records never fuse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b["content"]:
                got = extractor(content, None)
                for _ in range(max_gleaning):
                    more = extractor(content, got)
                    if not more:
                        break
                    got = got + T.RECORD + more
                out.append(got)
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "output": out})

    return chunks.select("chunk_id", "content").mapInPandas(run, "chunk_id string, output string")


def records(output: DataFrame, id_col: str = "chunk_id", text_col: str = "output") -> DataFrame:
    """(source_id, record_seq, f): the stripped fields of each parenthesised record."""
    lines = T.split_markers(F.col(text_col), [T.RECORD, T.COMPLETE])
    df = output.select(F.col(id_col).alias("source_id"), F.posexplode(lines).alias("record_seq", "__l"))
    body = T.record_body(F.col("__l"))
    return df.withColumn("__b", body).where(F.col("__b").isNotNull()).select("source_id", "record_seq", T.split_markers(F.col("__b"), [T.FIELD]).alias("f"))


def entities(recs: DataFrame, html_entities: bool = True) -> DataFrame:
    """Entity records: name (upper-cased, then cleaned), type, description, raw properties."""
    f = F.col("f")
    df = recs.where((f[0] == '"Entity"') & (F.size(f) >= 4))
    c = lambda x: T.clean(x, html_entities)
    return df.select(
        c(F.upper(f[1])).alias("entity_name"),
        c(F.upper(f[2])).alias("entity_type"),
        c(f[3]).alias("description"),
        F.slice("f", F.lit(5), F.greatest(F.size("f") - 4, F.lit(0))).alias("additional_properties"),
        "source_id",
        "record_seq",
    ).where("entity_name <> ''")


def hyperedges(recs: DataFrame, html_entities: bool = True) -> DataFrame:
    """Low- and high-order records: members, description, generalization, keywords, weight."""
    f, n = F.col("f"), F.size("f")
    high = f[0] == '"High-order Hyperedge"'
    df = recs.where(((f[0] == '"Low-order Hyperedge"') & (n >= 6)) | (high & (n >= 7)))
    names = F.slice("f", F.lit(2), F.when(high, n - 5).otherwise(n - 4))
    upper = F.transform(names, lambda x: F.regexp_replace(T.strip(F.upper(x)), r"[\x00-\x1f\x7f-\x9f]", ""))
    c = lambda x: T.clean(x, html_entities)
    return df.select(
        T.canonical(F.filter(upper, lambda x: x != "")).alias("members"),
        c(F.when(high, f[n - 4]).otherwise(f[n - 3])).alias("description"),
        F.when(high, f[n - 3]).otherwise("").alias("generalization"),
        c(f[n - 2]).alias("keywords"),
        T.weight(f[n - 1]).alias("weight"),
        F.when(high, "high").otherwise("low").alias("level_hg"),
        "source_id",
        "record_seq",
    ).where(F.size("members") > 0)


def progress(entity_records: DataFrame, edge_records: DataFrame) -> DataFrame:
    """Distinct entities and relations of each chunk, summed: entities, low, high, relations."""
    e = entity_records.select("source_id", "entity_name").distinct().select(F.lit("entity").alias("kind"))
    r = edge_records.select("source_id", T.edge_key(F.col("members")).alias("k"), "level_hg").distinct().select(F.col("level_hg").alias("kind"))
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return e.unionAll(r).agg(n("entity").alias("n_entities"), n("low").alias("n_low"), n("high").alias("n_high"), n("low", "high").alias("n_relations"))
