"""Hypergraph operators on vertices, hyperedges and incidence (ids J8-J13, A9-A11, P9, P13-P14, X21-X24, V1-V3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.merge import combine_edges


def incidence(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode("entity_set").alias("entity_name"), "edge_key")


def vertex_degree(edges: DataFrame) -> DataFrame:
    """Edges at each vertex."""
    return incidence(edges).groupBy("entity_name").agg(F.count("*").alias("degree"))


def counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    rows = vertices.select(F.lit(True).alias("v")).unionAll(edges.select(F.lit(False).alias("v")))
    return rows.agg(F.count_if("v").alias("n_vertices"), F.count_if(~F.col("v")).alias("n_edges"))


def frequent_vertices(edges: DataFrame, least: int = 2) -> DataFrame:
    return vertex_degree(edges).where(F.col("degree") >= least)


def neighbors(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(entity_name, neighbor) pairs that share an edge, self excluded.

    Members travel inside the edge's array: one join by edge for given seeds, none for all."""
    if seeds is None:
        pairs = edges.select(F.explode("entity_set").alias("entity_name"), "entity_set")
    else:
        hit = incidence(edges).join(seeds.select("entity_name").distinct(), "entity_name")
        pairs = hit.join(edges.select("edge_key", "entity_set"), "edge_key")
    return pairs.select("entity_name", F.explode("entity_set").alias("neighbor")).where("entity_name <> neighbor").distinct()


def incident_edges(edges: DataFrame, vertex: str) -> DataFrame:
    return edges.where(F.array_contains("entity_set", vertex))


def edge_neighborhood(edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) around an edge: its members with their neighbours, and all their edges."""
    members = edges.where(F.col("edge_key") == key).select(F.explode("entity_set").alias("entity_name"))
    near = incidence(edges).join(members, "entity_name").select("edge_key").distinct()
    near = edges.join(near, "edge_key", "left_semi")
    return near.select(F.explode("entity_set").alias("entity_name")).distinct(), near


def hops(edges: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """(entity_name, hop): vertices within ``most`` hops of any seed, by least distance."""
    out = seeds.select("entity_name").distinct().withColumn("hop", F.lit(0))
    front = out
    for h in range(1, most + 1):
        step = neighbors(edges, front).select(F.col("neighbor").alias("entity_name")).distinct().withColumn("hop", F.lit(h))
        front = step.join(out, "entity_name", "left_anti")
        out = out.unionByName(front)
    return out


def has_vertices(vertices: DataFrame, names: DataFrame) -> DataFrame:
    return names.join(vertices, "entity_name", "left_semi")


def has_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Member lists (column members) that are an edge of the graph."""
    keyed = members.withColumn("edge_key", T.edge_key(F.col("members")))
    return keyed.join(edges, "edge_key", "left_semi").drop("edge_key")


def remove_vertices(vertices: DataFrame, edges: DataFrame, gone: list[str]) -> tuple[DataFrame, DataFrame]:
    """The graph without some vertices: their edges shrink, edges below two members
    go, and edges that become equal merge.  Untouched edges are not shuffled."""
    drop = F.array(*[F.lit(g) for g in gone])
    touched = F.arrays_overlap("entity_set", drop)
    cut = edges.where(touched).withColumn("entity_set", F.array_except("entity_set", drop)).where(F.size("entity_set") >= 2)
    cut = cut.withColumn("edge_key", T.edge_key(F.col("entity_set")))
    kept = edges.where(~touched)
    meets = kept.join(cut.select("edge_key").distinct(), "edge_key", "left_semi")
    merged = combine_edges(cut.unionByName(meets.select(*cut.columns)))
    rest = kept.join(cut.select("edge_key").distinct(), "edge_key", "left_anti")
    return vertices.where(~F.col("entity_name").isin(gone)), rest.unionByName(merged.select(*rest.columns))


def remove_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select("edge_key").distinct(), "edge_key", "left_anti")


def upsert(stored: DataFrame, rows: DataFrame, key: str, must_exist: bool = False) -> DataFrame:
    """Field-wise: new non-empty values win, other fields stay; new keys are added."""
    fields = [c for c in stored.columns if c != key]
    new = rows.dropDuplicates([key])
    new = new.select(key, *[(F.col(c) if c in new.columns else F.lit(None)).cast(stored.schema[c].dataType).alias(f"__{c}") for c in fields])

    def pick(c: str):
        n = F.col(f"__{c}")
        if stored.schema[c].dataType.simpleString() == "string":
            n = F.nullif(n, F.lit(""))
        return F.coalesce(n, F.col(c)).alias(c)

    return stored.join(new, key, "left" if must_exist else "full").select(key, *[pick(c) for c in fields])


def clique_expansion(edges: DataFrame) -> DataFrame:
    """(edge_key, a, b) for all member pairs of each edge, in member order."""
    pair = edges.select("edge_key", "entity_set", F.posexplode("entity_set").alias("__i", "a"))
    return pair.select("edge_key", "a", F.explode(F.slice("entity_set", F.col("__i") + 2, F.size("entity_set"))).alias("b"))


def hydrate(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Keys with their payload; lists as joined text, keywords joined by commas."""
    texts = [F.array_join(c, "," if c == "keywords" else T.SEP).alias(c) for c, kind in table.dtypes if kind == "array<string>" and c not in (key, "entity_set")]
    plain = [c for c, kind in table.dtypes if c != key and (kind != "array<string>" or c == "entity_set")]
    return keys.join(table.select(key, *plain, *texts), key)


def neighborhood(vertices: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The payload around a vertex: its edges, and their members with all fields; both empty for
    a name that the graph does not know."""
    near = incident_edges(edges, name)
    members = near.select(F.explode("entity_set").alias("entity_name")).distinct()
    return hydrate(members, vertices, "entity_name"), hydrate(near.select("edge_key"), edges, "edge_key")


def display_edges(edges: DataFrame) -> DataFrame:
    """Edges for a listing: joined id, members, comma-joined keywords as description."""
    words = F.array_join("keywords", ",")
    return edges.select(F.array_join("entity_set", T.LIST_SEP).alias("id"), F.col("entity_set").alias("vertices"), words.alias("keywords"), F.array_join("description", T.SEP).alias("summary"), words.alias("description"))
