"""The test hypergraphs as plans over the driver's tables.

Vertex: a part's brand (dense) or the part itself (sparse).  Hyperedge: the distinct
vertices of one order; orders are the chunks.  Orders of equal sets merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import graph, merge, rank, vector
from loomgraph.operators.retrieve import Graph
from loomgraph.session import importable


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def order_lines(spark: SparkSession, d: str, sparse: bool = False) -> DataFrame:
    """(l_orderkey, entity_name, l_quantity)"""
    li = table(spark, d, "lineitem")
    if sparse:
        return li.select("l_orderkey", F.concat(F.lit("p"), "l_partkey").alias("entity_name"), "l_quantity")
    return li.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_brand").alias("entity_name"), "l_quantity")


def edge_records(spark: SparkSession, d: str, sparse: bool = False) -> DataFrame:
    """One record an order: members, weight, source, description (priority), keywords (status)."""
    g = order_lines(spark, d, sparse).groupBy("l_orderkey").agg(F.collect_set("entity_name").alias("members"), F.sum("l_quantity").alias("weight"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("description"), F.col("o_orderstatus").alias("keywords"))
    return g.join(o, "l_orderkey").withColumn("source_id", F.concat(F.lit("order-"), "l_orderkey"))


def edges(spark: SparkSession, d: str, sparse: bool = False) -> DataFrame:
    return merge.merge_edges(edge_records(spark, d, sparse))


def entity_records(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_brand").alias("entity_name"),
        F.col("p_type").alias("entity_type"),
        F.col("p_name").alias("description"),
        F.array(F.concat(F.lit("size "), "p_size")).alias("additional_properties"),
        F.concat(F.lit("part-"), "p_partkey").alias("source_id"),
        F.col("p_partkey").alias("record_seq"),
    )


def vertices(spark: SparkSession, d: str) -> DataFrame:
    """Brands with the merged payload of their parts; their sources are orders."""
    src = order_lines(spark, d).groupBy("entity_name").agg(F.array_sort(F.collect_set(F.concat(F.lit("order-"), "l_orderkey"))).alias("source_id"))
    return merge.merge_entities(entity_records(spark, d)).drop("source_id").join(src, "entity_name")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("order-"), "o_orderkey")
    return table(spark, d, "orders").select(key.alias("chunk_id"), F.concat_ws(" ", key, "o_orderstatus", "o_orderpriority").alias("content"))


def the_graph(spark: SparkSession, d: str) -> Graph:
    return Graph(vertices(spark, d), edges(spark, d), chunks(spark, d))


def question(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """A stored vector as the question's embedding."""
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def entity_hits(spark: SparkSession, d: str, k: int = 6) -> DataFrame:
    """(rank, entity_name): brand n has vector n."""
    names = table(spark, d, "part").select("p_brand").distinct().select(F.col("p_brand").alias("entity_name"), F.substring("p_brand", 7, 9).cast("int").alias("vec_id"))
    vec = names.join(table(spark, d, "embeddings"), "vec_id")
    top = vector.top_k(vec, question(spark, d), k, 0.0, id_col="entity_name")
    return rank.ranked(top, "rank", [F.desc("sim"), F.asc("entity_name")]).select("rank", "entity_name", "sim")


def edge_hits(spark: SparkSession, d: str, k: int = 40, e: DataFrame | None = None) -> DataFrame:
    """(rank, edge_key): every edge has the stored vector that its key's digest picks."""
    stored = table(spark, d, "embeddings")
    pick = F.conv(F.substring(F.md5("edge_key"), 1, 8), 16, 10).cast("long") % stored.count()
    vec = (e if e is not None else edges(spark, d)).select("edge_key", pick.alias("vec_id")).join(stored, "vec_id")
    top = vector.top_k(vec, question(spark, d), k, 0.0, id_col="edge_key")
    return rank.ranked(top, "rank", [F.desc("sim"), F.asc("edge_key")]).select("rank", "edge_key")


def degree(spark: SparkSession, d: str, sparse: bool = False) -> DataFrame:
    return graph.vertex_degree(edges(spark, d, sparse))
