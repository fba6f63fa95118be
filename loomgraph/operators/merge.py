"""Records to merged vertices and hyperedges (ids X12-X17, A1-A8, J17).

Every merge is one grouped aggregation on the entity name or edge key; set unions
and sums combine before the shuffle.  Stored rows take part as further records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def union(col: str) -> Column:
    """Sorted distinct values of a grouped column."""
    return F.array_sort(F.collect_set(col))


def union_lists(col: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(col))))


def vote_type(records: DataFrame, key: str = "entity_name", value: str = "entity_type", seq: str = "record_seq") -> DataFrame:
    """The most frequent value of each key; ties go to the first seen.

    Counted by (key, value) first, so a key with very many records costs one row a value."""
    n = records.groupBy(key, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def merge_entities(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """entity_name, entity_type, description, additional_properties, source_id (arrays sorted, distinct).

    Records are later than stored rows but vote first; an UNKNOWN placeholder neither
    votes nor adds text where a real record exists."""
    new = records.select(
        "entity_name",
        "entity_type",
        F.array("description").alias("description"),
        "additional_properties",
        F.array("source_id").alias("source_id"),
        F.col("record_seq").cast("long").alias("record_seq"),
    )
    rows = new
    if stored is not None:
        rows = new.unionByName(stored.withColumn("record_seq", F.lit((1 << 62)).cast("long")).select(*new.columns))
    real = (F.col("entity_type") != T.UNKNOWN).cast("int")
    kind = rows.groupBy("entity_name", "entity_type").agg(F.count("*").alias("n"), F.min("record_seq").alias("first"))
    kind = kind.groupBy("entity_name").agg(F.max_by("entity_type", F.struct(real, "n", -F.col("first"))).alias("entity_type"))
    body = rows.groupBy("entity_name").agg(union_lists("description").alias("description"), union_lists("additional_properties").alias("additional_properties"), union_lists("source_id").alias("source_id"))
    text = F.array_remove("description", T.UNKNOWN)
    return kind.join(body, "entity_name").withColumn("description", F.when(F.size(text) > 0, text).otherwise(F.col("description")))


#: What an edge keeps of its records' level.
LEVELS = ("generalization", "level_hg")


def merge_edges(records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """edge_key, entity_set, description, keywords, source_id (arrays), weight (sum), arity; where
    records have them, generalization (union) and level_hg (``high`` if any record is) too."""
    extra = [c for c in LEVELS if c in records.columns]
    as_list = F.filter(F.array("generalization"), lambda x: x.isNotNull() & (x != ""))
    new = records.select(
        *[(as_list if c == "generalization" else F.col(c)).alias(c) for c in extra],
        T.canonical(F.col("members")).alias("entity_set"),
        F.array("description").alias("description"),
        F.filter(F.transform(F.split("keywords", T.quote(T.SEP)), T.strip), lambda x: x != "").alias("keywords"),
        F.array("source_id").alias("source_id"),
        "weight",
    )
    rows = new.withColumn("edge_key", T.edge_key(F.col("entity_set")))
    if stored is not None:
        both = ("edge_key", "entity_set", "description", "keywords", "source_id", "weight", *[c for c in extra if c in stored.columns])
        rows = rows.unionByName(stored.select(*both), allowMissingColumns=True)
    return combine_edges(rows)


def combine_edges(rows: DataFrame) -> DataFrame:
    """Merges edge rows of one key: unions and the sum of weights."""
    levels = {"generalization": F.array_sort(F.array_distinct(F.flatten(F.collect_set("generalization")))), "level_hg": F.min("level_hg")}
    return (
        rows.groupBy("edge_key")
        .agg(
            F.any_value("entity_set").alias("entity_set"),
            union_lists("description").alias("description"),
            union_lists("keywords").alias("keywords"),
            union_lists("source_id").alias("source_id"),
            F.sum("weight").alias("weight"),
            # "high" comes before "low"
            *[levels[c].alias(c) for c in LEVELS if c in rows.columns],
        )
        .withColumn("arity", F.size("entity_set"))
    )


def backfill_unknown(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices`` plus a placeholder for each edge member that has none, with the edges' sources."""
    return vertices.unionByName(unknown_stubs(vertices, edges))


def unknown_stubs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """A placeholder for each edge member that is no vertex."""
    members = edges.select(F.explode("entity_set").alias("entity_name"), "source_id")
    missing = members.join(vertices.select("entity_name"), "entity_name", "left_anti")
    stub = missing.groupBy("entity_name").agg(union_lists("source_id").alias("source_id"))
    return stub.select(
        "entity_name",
        F.lit(T.UNKNOWN).alias("entity_type"),
        F.array(F.lit(T.UNKNOWN)).alias("description"),
        F.array(F.lit(T.UNKNOWN)).alias("additional_properties"),
        "source_id",
    )


def summarise(df: DataFrame, col: str, limit: int, summary: Callable[[DataFrame, str], DataFrame] | None = None, sep: str = T.SEP) -> DataFrame:
    """Texts of ``limit`` tokens or more go through ``summary``; the rest never reach it.

    ``summary(rows, column)`` returns the rows with the column rewritten (null keeps the text)."""
    if summary is None:
        return df
    joined = F.array_join(col, sep)
    long = T.token_count(joined) >= limit
    kept = df.where(~long | F.col(col).isNull())
    cut = df.where(long).withColumn("__text", joined)
    cut = summary(cut, "__text").withColumn(col, F.when(F.col("__text").isNotNull(), F.array("__text")).otherwise(F.col(col))).drop("__text")
    return kept.unionByName(cut)


def entity_vector_text(vertices: DataFrame, typed: bool = False) -> DataFrame:
    """(id, entity_name, text): what the entity index embeds, if ``typed`` with the type in it."""
    text = F.concat("entity_name", F.array_join("description", T.SEP))
    if typed:
        text = F.concat(F.lit("Type: "), "entity_type", F.lit("; Name: "), "entity_name", F.lit("; Description: "), F.array_join("description", T.SEP))
    return vertices.where(F.col("entity_type") != T.UNKNOWN).select(T.content_id(F.col("entity_name"), "ent-").alias("id"), "entity_name", text.alias("text"))


def edge_vector_text(edges: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(id, edge_key, text): what the relation index embeds; with ``types`` (entity_name,
    entity_type) every member stands with its type."""
    text = F.concat(F.array_join("keywords", T.SEP), F.array_join("entity_set", ", "), F.array_join("description", T.SEP))
    if types is not None:
        member = edges.select("edge_key", F.explode("entity_set").alias("entity_name")).join(types.select("entity_name", "entity_type"), "entity_name", "left")
        said = F.concat("entity_name", F.lit(" ["), F.coalesce("entity_type", F.lit(T.UNKNOWN)), F.lit("]"))
        named = member.groupBy("edge_key").agg(F.array_join(F.array_sort(F.collect_list(said)), ", ").alias("__members"))
        edges = edges.join(named, "edge_key")
        text = F.concat(F.lit("Members: "), "__members", F.lit("; Keywords: "), F.array_join("keywords", ", "), F.lit("; Description: "), F.array_join("description", T.SEP))
    return edges.select(T.content_id(F.col("edge_key"), "rel-").alias("id"), "edge_key", text.alias("text"))
