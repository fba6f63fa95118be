"""Query-adaptive retrieval: typing, routing, soft weights, diffusion, quality (ids R2-R7, A16).

Thresholds and weights are this engine's own defaults, all parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph


def typed_validity(edges: DataFrame, patterns: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """edges(edge_key, relation, type_a, type_b) plus schema_validity: ``valid`` for an allowed
    (relation, type, type) pattern, ``weak_valid`` where a type is OTHER, else ``invalid``."""
    e = edges
    if aliases is not None:
        e = e.join(aliases, "relation", "left").withColumn("relation", F.coalesce("canonical", "relation")).drop("canonical")
    ok = patterns.select("relation", "type_a", "type_b").distinct().withColumn("__ok", F.lit(True))
    e = e.join(ok, ["relation", "type_a", "type_b"], "left")
    weak = (F.col("type_a") == "OTHER") | (F.col("type_b") == "OTHER")
    return e.withColumn("schema_validity", F.when(F.col("__ok"), "valid").when(weak, "weak_valid").otherwise("invalid")).drop("__ok")


def validity_ratios(rows: DataFrame, most_other: float = 0.2, most_invalid: float = 0.1) -> DataFrame:
    other = F.avg(((F.col("type_a") == "OTHER") | (F.col("type_b") == "OTHER")).cast("int"))
    bad = F.avg((F.col("schema_validity") == "invalid").cast("int"))
    out = rows.agg(other.alias("other_ratio"), bad.alias("invalid_ratio"))
    return out.withColumn("accepted", (F.col("other_ratio") <= most_other) & (F.col("invalid_ratio") <= most_invalid))


def route(questions: DataFrame, rules: list[tuple[str, str]], col: str = "question", long_question: int = 12) -> DataFrame:
    """query_type by the first rule (pattern, type) that matches, and complexity by length
    and by how many rules match."""
    q = F.lower(F.col(col))
    kind = F.coalesce(*[F.when(q.rlike(p), F.lit(t)) for p, t in rules], F.lit("general"))
    n = sum((q.rlike(p).cast("int") for p, _ in rules), F.lit(0))
    words = F.size(F.array_remove(F.split(q, r"\s+"), ""))
    level = F.when((n >= 2) | (words > long_question), "complex").when(n == 1, "medium").otherwise("simple")
    return questions.select("*", kind.alias("query_type"), level.alias("complexity"))


def plan_for(complexity: Column) -> Column:
    """struct(k, hops) of a complexity."""
    return F.when(complexity == "complex", F.struct(F.lit(60).alias("k"), F.lit(2).alias("hops"))).when(complexity == "medium", F.struct(F.lit(40).alias("k"), F.lit(1).alias("hops"))).otherwise(F.struct(F.lit(20).alias("k"), F.lit(1).alias("hops")))


def soft_weight(hits: DataFrame, targets: list[str], boost: float = 1.0, rest: float = 0.7, type_col: str = "entity_type") -> DataFrame:
    """Hits re-weighted by type; none is dropped."""
    return hits.withColumn("soft_sim", F.round(F.col("sim") * F.when(F.col(type_col).isin(targets), boost).otherwise(rest), 6))


def diffusion(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.5) -> DataFrame:
    """Vertices within ``hops`` of the seeds with weight decay**hop."""
    return graph.hops(edges, seeds, hops).withColumn("diffusion", F.pow(F.lit(decay), F.col("hop")))


#: Default weights of an edge's quality.
WEIGHTS = {"cover": 0.4, "type": 0.2, "source": 0.2, "arity": 0.2, "similarity": 0.0, "keyword": 0.0, "degree": 0.0, "hop": 0.0}


def edge_quality(
    edges: DataFrame,
    seeds: DataFrame,
    targets: list[str],
    vertices: DataFrame,
    *,
    weights: dict[str, float] | None = None,
    most_arity: int = 8,
    sims: DataFrame | None = None,
    near: DataFrame | None = None,
    keywords: list[str] | None = None,
    high_degree: int = 50,
) -> DataFrame:
    """Edges with a composite quality: cover of the seeds, target types, sources, arity; by weight also
    similarity (``sims``: edge_key, sim), shared ``keywords``, hop (``near``: entity_name, hop;
    1 / (1 + least hop)), and a penalty for members of over ``high_degree`` edges.

    Seeds, similarities and keywords are a question's: small by its top k.  Joins have no hints."""
    wt = WEIGHTS | (weights or {})
    n = max(seeds.select("entity_name").distinct().count(), 1)
    names = seeds.select("entity_name").distinct().withColumn("__seed", F.lit(1))
    member = graph.incidence(edges).join(names, "entity_name", "left").join(vertices.select("entity_name", "entity_type"), "entity_name", "left")
    aggs = [F.sum(F.coalesce("__seed", F.lit(0))).alias("hit"), F.avg(F.col("entity_type").isin(targets).cast("int")).alias("typed")]
    if wt["degree"]:
        member = member.join(graph.vertex_degree(edges), "entity_name")
        aggs.append(F.avg((F.col("degree") > high_degree).cast("int")).alias("__high"))
    if near is not None:
        member = member.join(near.select("entity_name", "hop"), "entity_name", "left")
        aggs.append(F.min("hop").alias("__hop"))
    e = edges.join(member.groupBy("edge_key").agg(*aggs), "edge_key")
    if sims is not None:
        e = e.join(sims.select("edge_key", F.col("sim").alias("__sim")), "edge_key", "left")
    asked = F.array(*[F.lit(k) for k in keywords or []]).cast("array<string>")
    terms = {
        "cover": F.col("hit") / n,
        "type": F.coalesce("typed", F.lit(0.0)),
        "source": 1 - 1 / (1 + F.size("source_id").cast("double")),
        "arity": F.least(F.col("arity"), F.lit(most_arity)) / most_arity,
        "similarity": F.coalesce("__sim", F.lit(0.0)) if sims is not None else F.lit(0.0),
        "keyword": F.size(F.array_intersect("keywords", asked)) / max(len(keywords or []), 1),
        "degree": -F.coalesce("__high", F.lit(0.0)) if wt["degree"] else F.lit(0.0),
        "hop": F.coalesce(1 / (1 + F.col("__hop")), F.lit(0.0)) if near is not None else F.lit(0.0),
    }
    q = sum((wt[name] * term for name, term in terms.items() if wt[name]), F.lit(0.0))
    return e.select("edge_key", F.round(q, 6).alias("quality"), "hit", "arity", F.lit(n).alias("n_seeds"))


def roles(edges: DataFrame) -> DataFrame:
    """Evidence roles: direct (all seeds met), high_order (arity above 2), supporting."""
    return edges.withColumn("role", F.when(F.col("hit") >= F.col("n_seeds"), "direct").when(F.col("arity") > 2, "high_order").otherwise("supporting"))


#: What each ablation configuration switches on.
ABLATION = {
    "naive": set(),
    "original": {"graph"},
    "typed": {"graph", "typed"},
    "query_aware": {"graph", "typed", "router"},
    "adaptive": {"graph", "typed", "router", "diffusion"},
    "full": {"graph", "typed", "router", "diffusion", "quality", "roles"},
}


def ablated(edges: DataFrame, hits: DataFrame, targets: list[str], vertices: DataFrame, config: str, *, k: int = 20, hops: int = 1) -> DataFrame:
    """(config, edge_key, score, role) of a question's ``k`` best edges under a configuration.

    hits: (entity_name, sim).  Without a graph nothing is found; plain graphs score by the best
    hit's similarity, typed ones weigh it by type, diffusion reaches further members with a
    decay, full ranks by edge quality and gives roles."""
    on = ABLATION[config]
    none = F.lit(None).cast("string")
    if "graph" not in on:
        return edges.limit(0).select(F.lit(config).alias("config"), "edge_key", F.lit(0.0).alias("score"), none.alias("role"))
    hits = hits.join(vertices.select("entity_name", "entity_type"), "entity_name")
    hits = soft_weight(hits, targets) if "typed" in on else hits.withColumn("soft_sim", F.col("sim"))
    reach = hits.select("entity_name", F.col("soft_sim").alias("s"))
    if "diffusion" in on and hops > 1:
        top = hits.agg(F.max("soft_sim").alias("m")).first()["m"] or 0.0
        far = diffusion(edges, hits, hops - 1).where("hop > 0").select("entity_name", F.round(F.lit(top) * F.col("diffusion"), 6).alias("s"))
        reach = reach.unionByName(far)
    best = graph.incidence(edges).join(reach, "entity_name").groupBy("edge_key").agg(F.max("s").alias("score"))
    out = best.withColumn("role", none)
    if "quality" in on:
        q = roles(edge_quality(edges, hits, targets, vertices, sims=best.select("edge_key", F.col("score").alias("sim")), weights={"similarity": 0.3}))
        out = best.select("edge_key").join(q.select("edge_key", F.col("quality").alias("score"), "role"), "edge_key")
    out = out.orderBy(F.desc("score"), F.asc("edge_key")).limit(k)
    return out.select(F.lit(config).alias("config"), "edge_key", "score", "role")
