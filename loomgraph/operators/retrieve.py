"""Retrieval lines over a hypergraph (ids C1-C2, U1-U2, P6-P8, J1-J7).

Every function takes hit tables that a top-k has cut to at most a few hundred rows
(columns ``rank`` and an id); they are small by that bound, whatever the graph's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph
from loomgraph.operators.rank import edge_order, first_wins, ranked, token_budget


@dataclass(frozen=True)
class Graph:
    """vertices(entity_name, entity_type, description, additional_properties, source_id),
    edges(edge_key, entity_set, description, keywords, source_id, weight, arity),
    chunks(chunk_id, content)."""

    vertices: DataFrame
    edges: DataFrame
    chunks: DataFrame


@dataclass(frozen=True)
class Budgets:
    text: int = 1600
    entity: int = 300
    relation: int = 1600


def _said(col: str = "description"):
    return F.array_join(col, T.SEP)


def entity_hits(g: Graph, hits: DataFrame) -> DataFrame:
    """Hits (rank, entity_name) that are vertices, with payload and degree, in order."""
    v = g.vertices.join(hits, "entity_name")
    near = graph.incidence(g.edges).join(hits.select("entity_name"), "entity_name")
    degree = near.groupBy("entity_name").agg(F.count("*").alias("degree"))
    return v.join(degree, "entity_name", "left").fillna(0, ["degree"])


def entity_edges(g: Graph, hits: DataFrame, budget: int) -> DataFrame:
    """Edges at the hit vertices, by arity and weight, cut at the token budget."""
    names = hits.select("entity_name")
    keys = graph.incidence(g.edges).join(names, "entity_name").select("edge_key").distinct()
    found = g.edges.join(keys, "edge_key", "left_semi").withColumn("said", _said())
    return token_budget(found, "said", budget, edge_order())


def entity_chunks(g: Graph, hits: DataFrame, budget: int) -> DataFrame:
    """Chunks of the hit vertices: by first citing hit, then by how many (edge, member)
    around that hit share the chunk."""
    v = g.vertices.join(hits, "entity_name").select("rank", "entity_name", F.explode("source_id").alias("chunk_id"))
    first = v.groupBy("chunk_id").agg(F.min_by(F.struct("rank", "entity_name"), "rank").alias("x")).select("chunk_id", F.col("x.rank").alias("rank"), F.col("x.entity_name").alias("entity_name"))
    around = graph.incidence(g.edges).join(hits.select("entity_name"), "entity_name")
    members = around.join(g.edges.select("edge_key", "entity_set"), "edge_key").select("entity_name", F.explode("entity_set").alias("member"))
    # a member met through several edges counts once an edge
    times = members.groupBy("entity_name", "member").agg(F.count("*").alias("n"))
    cites = times.join(g.vertices.select(F.col("entity_name").alias("member"), "source_id"), "member")
    cites = cites.select("entity_name", "n", F.explode("source_id").alias("chunk_id"))
    rel = cites.groupBy("entity_name", "chunk_id").agg(F.sum("n").alias("relation_counts"))
    rows = first.join(rel, ["entity_name", "chunk_id"], "left").fillna(0, ["relation_counts"]).join(g.chunks, "chunk_id")
    order = [F.asc("rank"), F.desc("relation_counts"), F.asc("chunk_id")]
    return token_budget(rows, "content", budget, order)


def relation_edges(g: Graph, hits: DataFrame, budget: int) -> DataFrame:
    """Hit edges (rank, edge_key) by arity and weight (ties by rank), cut at the budget."""
    order = [F.desc("arity"), F.desc("weight"), F.asc("rank")]
    found = g.edges.join(hits, "edge_key").withColumn("said", _said())
    return ranked(token_budget(found, "said", budget, order), "pos", order)


def relation_entities(g: Graph, edges: DataFrame, budget: int) -> DataFrame:
    """Members of the kept edges that are vertices, by first edge and name, cut at the budget."""
    members = edges.select("pos", F.explode("entity_set").alias("entity_name")).groupBy("entity_name").agg(F.min("pos").alias("pos"))
    order = [F.asc("pos"), F.asc("entity_name")]
    found = g.vertices.join(members, "entity_name").withColumn("said", _said())
    return token_budget(found, "said", budget, order)


def relation_chunks(g: Graph, edges: DataFrame, budget: int) -> DataFrame:
    """Chunks of the kept edges by first edge, cut at the budget."""
    src = edges.select("pos", F.explode("source_id").alias("chunk_id")).groupBy("chunk_id").agg(F.min("pos").alias("pos"))
    order = [F.asc("pos"), F.asc("chunk_id")]
    return token_budget(g.chunks.join(src, "chunk_id"), "content", budget, order)


def pairwise(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Hit edges of exactly two members; the filter follows the top-k."""
    return edges.join(hits, "edge_key").where(F.size("entity_set") == 2)


def combine(first: DataFrame, second: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Rows of two lines, the first line's first, one a key, numbered from 1."""
    rows = first.withColumn("__line", F.lit(0)).unionByName(second.withColumn("__line", F.lit(1)))
    by = [F.asc("__line"), F.asc(order)]
    return ranked(first_wins(rows, key, by), "id", by, start=1).drop("__line")


def chunk_context(hits: DataFrame, chunks: DataFrame, budget: int, cols: tuple[str, str] = ("chunk_id", "content")) -> DataFrame:
    """One row: the hit chunks (rank, chunk_id) in order, cut at the budget and joined."""
    rows = chunks.join(hits, cols[0])
    kept = token_budget(rows, cols[1], budget, [F.asc("rank")])
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(cols[1]).alias("content"))))
    return kept.agg(F.array_join(F.transform(ordered, lambda x: x["content"]), T.CHUNK_JOIN).alias("context"), F.count("*").alias("n_chunks"))


def section(rows: DataFrame, header: list[str], cols: list, order: list) -> DataFrame:
    """One CSV section (column csv) with ids from 0 in order."""
    numbered = ranked(rows, "__id", order)
    line = T.csv_row(F.col("__id").alias("id"), *cols)
    body = F.transform(F.array_sort(F.collect_list(F.struct("__id", line.alias("line")))), lambda x: x["line"])
    return numbered.agg(T.csv_section(header, body).alias("csv"))
