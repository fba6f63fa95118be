"""The registered queries of the retrieval engine; ``oracles.py`` has the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import adaptive, cache, evaluate, extract, graph, ingest, merge, rank, vector
from loomgraph.operators import retrieve as R
from loomgraph.plans import fixtures as X
from loomgraph.plans.fixtures import table
from loomgraph.sources import readers
from loomgraph.streaming.rate_limit import limit_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SIZE, OVERLAP, BUDGET = 64, 16, 5000


def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def joined(col: str, sep: str = ";"):
    return F.array_join(col, sep).alias(col)


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.col("text").alias("content"), "lang")


# ------------------------------------------------------------------ ingest
@register
def doc_dedup(s, d):
    key = T.content_id(T.strip(F.col("text")), "doc-")
    return table(s, d, "documents").groupBy(key.alias("doc_key")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def _keyed(s, d, even: bool):
    t = table(s, d, "documents").where((F.col("doc_id") % 2 == 0) == even)
    return ingest.doc_ids(t, "text")


@register
def new_docs(s, d):
    return ingest.new_rows(_keyed(s, d, False), _keyed(s, d, True), "doc_id").select("doc_id")


@register
def kv_insert_if_absent(s, d):
    def kv(even):
        t = table(s, d, "documents").where((F.col("doc_id") % 2 == 0) == even)
        return t.groupBy(F.concat(F.lit("k"), F.floor(F.col("doc_id") / 3)).alias("k")).agg(F.min("doc_id").alias("v"))

    return ingest.insert_if_absent(kv(True), kv(False), "k")


@register
def chunk_windows(s, d):
    return ingest.chunk_windows(docs(s, d), SIZE, OVERLAP).select("chunk_id", "full_doc_id", "chunk_order_index", "tokens")


@register
def chunk_dedup_last_wins(s, d):
    return ingest.last_wins(ingest.chunk_windows(docs(s, d), SIZE, OVERLAP)).select("chunk_id", "full_doc_id", "chunk_order_index")


@register
def token_budget(s, d):
    t = table(s, d, "documents")
    return rank.token_budget(t, "text", BUDGET, [F.asc("doc_id")], by=["lang"]).select("lang", "doc_id")


# -------------------------------------------------------------- extraction
def _entity_text(s, d):
    body = F.concat(F.lit('("Entity" | '), "p_name", F.lit(" | "), "p_type", F.lit(" | made by "), "p_brand", F.lit(" | size "), F.col("p_size").cast("string"), F.lit(")"))
    return table(s, d, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("chunk_id"), F.concat(F.lit("noise line\n"), body, F.lit(T.COMPLETE)).alias("output"))


def _edge_text(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("m"), F.sum("l_quantity").cast("int").cast("string").alias("w"))
    names = F.array_join("m", " | ")
    low = F.concat(F.lit('("Low-order Hyperedge" | '), names, F.lit(" | bought together | order | "), "w", F.lit(")"))
    high = F.concat(F.lit('("High-order Hyperedge" | '), names, F.lit(" | bought together | a basket | order | "), F.lit("n/a"), F.lit(")"))
    return g.select(F.concat(F.lit("order-"), "l_orderkey").alias("chunk_id"), F.concat(low, F.lit("\n"), high, F.lit("\n" + T.COMPLETE)).alias("output"))


@register
def entity_record_parse(s, d):
    e = extract.entities(extract.records(_entity_text(s, d)))
    return e.select("entity_name", "entity_type", "description", joined("additional_properties"), "source_id")


def _edge_parse(s, d, level):
    e = extract.hyperedges(extract.records(_edge_text(s, d))).where(F.col("level_hg") == level)
    return e.select(joined("members"), "description", "generalization", "keywords", "weight", "source_id")


@register
def edge_record_parse_low(s, d):
    return _edge_parse(s, d, "low")


@register
def edge_record_parse_high(s, d):
    return _edge_parse(s, d, "high")


@register
def extraction_progress(s, d):
    recs = extract.records(_entity_text(s, d).unionByName(_edge_text(s, d)))
    return extract.progress(extract.entities(recs), extract.hyperedges(recs))


# ------------------------------------------------------------------- merge
@register
def entity_type_vote(s, d):
    e = table(s, d, "events")
    return merge.vote_type(e, "user_id", "event_type", "event_id")


@register
def entity_merge(s, d):
    m = merge.merge_entities(X.entity_records(s, d))
    return m.select("entity_name", "entity_type", joined("description"), joined("additional_properties"), F.size("source_id").alias("n_sources"))


def _edge_columns(e):
    return e.select("edge_key", "arity", "weight", joined("description"), joined("keywords"), F.size("source_id").alias("n_sources"))


@register
def edge_merge(s, d):
    return _edge_columns(X.edges(s, d))


@register
def edge_merge_incremental(s, d):
    r = X.edge_records(s, d)
    stored = merge.merge_edges(r.where("l_orderkey % 2 = 0"))
    return _edge_columns(merge.merge_edges(r.where("l_orderkey % 2 = 1"), stored))


@register
def unknown_backfill(s, d):
    v = X.vertices(s, d).where("entity_name > 'Brand#2'")
    out = merge.backfill_unknown(v, X.edges(s, d))
    return out.select("entity_name", "entity_type", F.size("source_id").alias("n_sources"))


@register
def vector_texts(s, d):
    v = merge.entity_vector_text(X.vertices(s, d)).select("id", F.col("entity_name").alias("name"), F.md5("text").alias("text_md5"))
    e = merge.edge_vector_text(X.edges(s, d)).select("id", F.col("edge_key").alias("name"), F.md5("text").alias("text_md5"))
    return v.unionByName(e)


# ------------------------------------------------------------------- graph
@register
def vertex_degree(s, d):
    return X.degree(s, d)


@register
def edge_arity(s, d):
    return X.edges(s, d, True).groupBy("arity").agg(F.count("*").alias("n_edges"))


@register
def graph_counts(s, d):
    return graph.counts(X.vertices(s, d), X.edges(s, d))


@register
def vertex_neighbors(s, d):
    return graph.neighbors(X.edges(s, d))


@register
def vertex_neighbors_sparse(s, d):
    return graph.neighbors(X.edges(s, d, True))


@register
def incident_edges(s, d):
    return graph.incident_edges(X.edges(s, d, True), "p7").select("edge_key", "arity", "weight")


def _an_edge(e):
    return e.agg(F.min("edge_key")).first()[0]


@register
def edge_neighborhood(s, d):
    e = X.edges(s, d, True)
    v, near = graph.edge_neighborhood(e, _an_edge(e))
    return v.select(F.lit("vertex").alias("kind"), F.col("entity_name").alias("id")).unionByName(near.select(F.lit("edge").alias("kind"), F.col("edge_key").alias("id")))


@register
def two_hop(s, d):
    seeds = s.createDataFrame([("p7",)], "entity_name string")
    return graph.hops(X.edges(s, d, True), seeds, 2)


@register
def frequent_vertices(s, d):
    return graph.frequent_vertices(X.edges(s, d, True), 30)


@register
def vertex_page(s, d):
    return rank.page(X.vertices(s, d).select("entity_name", "entity_type"), [F.asc("entity_name")], 2, 10)


@register
def edge_page(s, d):
    e = graph.display_edges(X.edges(s, d)).drop("vertices")
    return rank.page(e, [F.asc("id")], 3, 20)


@register
def page_info(s, d):
    return rank.page_info(X.edges(s, d), 20)


@register
def remove_vertex(s, d):
    e = X.edges(s, d)
    _, out = graph.remove_vertices(X.vertices(s, d), e, ["Brand#7"])
    return out.select("edge_key", "weight", F.size("entity_set").alias("arity"), F.size("source_id").alias("n_sources"))


@register
def remove_edge(s, d):
    e = X.edges(s, d)
    gone = e.where("arity = 1").select("edge_key")
    return graph.remove_edges(e, gone).select("edge_key", "weight")


@register
def upsert_vertex(s, d):
    v = X.vertices(s, d).select("entity_name", "entity_type")
    new = s.createDataFrame([("Brand#1", "RENAMED"), ("Brand#2", ""), ("Brand#NEW", "FRESH")], "entity_name string, entity_type string")
    return graph.upsert(v, new, "entity_name")


@register
def vertex_exists(s, d):
    names = table(s, d, "supplier").select(F.concat(F.lit("Brand#"), "s_suppkey").alias("entity_name"))
    return graph.has_vertices(X.vertices(s, d), names)


@register
def edge_exists(s, d):
    pairs = s.createDataFrame([(["Brand#1", "Brand#2"],), (["Brand#2", "Brand#1", "Brand#3"],), (["Brand#1", "x"],)], "members array<string>")
    return graph.has_edges(X.edges(s, d), pairs).select(joined("members"))


@register
def clique_expansion(s, d):
    return graph.clique_expansion(X.edges(s, d))


@register
def pair_weights(s, d):
    """Clique expansion folded to one weighted pair graph."""
    e = X.edges(s, d)
    return graph.clique_expansion(e).join(e.select("edge_key", "weight"), "edge_key").groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.count("*").alias("n_edges"))


# ------------------------------------------------------------------ vectors
@register
def cosine_topk(s, d):
    return vector.top_k(table(s, d, "embeddings"), X.question(s, d), 60, 0.2, id_col="vec_id").select("vec_id", "sim")


@register
def cosine_topk_batch(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.top_k_batch(e, q, 10, 0.2, id_col="vec_id").select("query_id", "vec_id", "sim", "rank")


# ---------------------------------------------------------------- retrieval
@register
def naive_context(s, d):
    e = table(s, d, "embeddings")
    top = rank.ranked(vector.top_k(e, X.question(s, d), 60, 0.2, id_col="vec_id"), "rank", [F.desc("sim"), F.asc("vec_id")])
    chunks = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return R.chunk_context(top.select("rank", F.col("vec_id").alias("chunk_id")), chunks, 1600)


@register
def entity_line_entities(s, d):
    v = R.entity_hits(X.the_graph(s, d), X.entity_hits(s, d))
    return v.select("rank", "entity_name", "entity_type", "degree", joined("description"))


@register
def entity_line_edges(s, d):
    e = R.entity_edges(X.the_graph(s, d), X.entity_hits(s, d), 200)
    return rank.ranked(e, "pos", rank.edge_order()).select("pos", "edge_key", "arity", "weight")


@register
def entity_line_chunks(s, d):
    c = R.entity_chunks(X.the_graph(s, d), X.entity_hits(s, d), 400)
    return c.select("chunk_id", "rank", "relation_counts")


def _relation(s, d):
    g = X.the_graph(s, d)
    return g, R.relation_edges(g, X.edge_hits(s, d, e=g.edges), 60)


@register
def relation_line_edges(s, d):
    return _relation(s, d)[1].select("pos", "edge_key", "arity", "weight")


@register
def relation_line_entities(s, d):
    g, e = _relation(s, d)
    return R.relation_entities(g, e, 300).select("pos", "entity_name")


@register
def relation_line_chunks(s, d):
    g, e = _relation(s, d)
    return R.relation_chunks(g, e, 100).select("pos", "chunk_id")


@register
def pairwise_edges(s, d):
    e = X.edges(s, d)
    return R.pairwise(X.edge_hits(s, d, 200, e.where("arity <= 3")), e).select("rank", "edge_key", "weight")


def _both_lines(s, d):
    g, rel = _relation(s, d)
    hits = X.entity_hits(s, d)
    ent = (
        R.entity_hits(g, hits).select("entity_name", F.col("rank").alias("pos")),
        rank.ranked(R.entity_edges(g, hits, 200), "pos", rank.edge_order()).select("edge_key", "pos"),
        rank.ranked(R.entity_chunks(g, hits, 400), "pos", [F.asc("rank"), F.desc("relation_counts"), F.asc("chunk_id")]).select("chunk_id", "pos"),
    )
    members = rank.ranked(R.relation_entities(g, rel, 300), "p", [F.asc("pos"), F.asc("entity_name")]).select("entity_name", F.col("p").alias("pos"))
    chunks = rank.ranked(R.relation_chunks(g, rel, 100), "p", [F.asc("pos"), F.asc("chunk_id")]).select("chunk_id", F.col("p").alias("pos"))
    return ent, (members, rel.select("edge_key", "pos"), chunks)


@register
def hyper_entities(s, d):
    a, b = _both_lines(s, d)
    return R.combine(a[0], b[0], "entity_name").select("id", "entity_name")


@register
def hyper_edges(s, d):
    a, b = _both_lines(s, d)
    return R.combine(a[1], b[1], "edge_key").select("id", "edge_key")


@register
def hyper_sources(s, d):
    a, b = _both_lines(s, d)
    return R.combine(a[2], b[2], "chunk_id").select("id", "chunk_id")


@register
def csv_section(s, d):
    v = X.vertices(s, d).select("entity_name", F.concat(F.lit('says "'), "entity_type", F.lit('", twice')).alias("said"))
    out = R.section(v, ["id", "entity", "said"], [F.col("entity_name"), F.col("said")], [F.asc("entity_name")])
    return out.select(F.replace("csv", F.lit("\r\n"), F.lit("~")).alias("csv"))


# -------------------------------------------------- contexts, parsing, judging
@register
def distinct_contexts(s, d):
    t = table(s, d, "documents").select(F.md5("text").alias("context"), F.col("doc_id").alias("pos"))
    return rank.distinct_first(t, "context", "pos")


@register
def sliding_reference(s, d):
    t = table(s, d, "benchmark")
    return rank.sliding_join(t, "text", "item_id").select("item_id", F.md5("reference").alias("reference"))


@register
def jsonl_validation(s, d):
    e = table(s, d, "events")
    line = (
        F.when(F.col("event_id") % 10 == 0, F.lit("{broken"))
        .when(F.col("event_id") % 10 == 1, F.lit("[1]"))
        .when(F.col("event_id") % 10 == 2, F.lit('{"context": "  "}'))
        .when(F.col("event_id") % 10 == 3, F.lit(" "))
        .otherwise(F.concat(F.lit('{"context": "'), "event_type", F.lit('"}')))
    )
    return readers.jsonl_report(e.select(line.alias("value")))


@register
def keyword_parse(s, d):
    c = table(s, d, "customer")
    as_list = F.concat(F.lit('{"high_level_keywords": ["'), "c_mktsegment", F.lit('", "Z"], "low_level_keywords": "'), "c_name", F.lit('"}'))
    messy = F.concat(F.lit("user said {"), F.lit('"high_level_keywords": "'), "c_name", F.lit('", "low_level_keywords": []} and } that is all'))
    none = F.lit("no json here")
    text = F.when(F.col("c_custkey") % 3 == 0, as_list).when(F.col("c_custkey") % 3 == 1, messy).otherwise(none)
    k = T.keywords(text)
    return c.select("c_custkey", k["high"].alias("high"), k["low"].alias("low"))


@register
def score_mean(s, d):
    c = F.col("doc_id")
    one = lambda n, q: F.concat(F.lit(f'"M{n}": {{"Score": {q}'), ((c * (n + 3)) % 10).cast("string"), F.lit(q + "}"))
    text = F.concat_ws(", ", *[one(n, '"' if n % 2 else "") for n in range(5)])
    return evaluate.score_means(table(s, d, "labels").select(text.alias("answer")))


@register
def win_rate(s, d):
    c = F.col("doc_id")
    one = lambda n: F.concat(F.lit('{"Winner": "Answer '), (1 + (c + F.floor(c / (n + 2))) % 2).cast("int").cast("string"), F.lit('"}'))
    return evaluate.win_rates(table(s, d, "labels").select(F.concat_ws(" ", *[one(n) for n in range(8)]).alias("answer")))


@register
def outcome_counts(s, d):
    return evaluate.outcome_counts(table(s, d, "events").select((F.col("event_type") != "error").alias("ok")))


@register
def message_pack(s, d):
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    m = c.select("conv_id", F.posexplode(T.pack_messages(F.transform("x", lambda x: x["text"]))).alias("pos", "m"))
    return m.select("conv_id", "pos", "m.role", F.md5("m.content").alias("content"))


@register
def cache_lookup(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.md5(F.concat("role", F.lit("/"), "text")).alias("args_hash"))
    known = c.where("conv_id % 2 = 0").dropDuplicates(["args_hash"]).select("args_hash", F.upper("args_hash").alias("return"))
    return cache.lookup(c, known).select("conv_id", "turn", "cached")


@register
def db_name(s, d):
    last = F.substring_index("url", "/", -1)
    return table(s, d, "pages").select("page_id", T.database_name(last).alias("db"))


@register
def rate_limit(s, d):
    return limit_batch(table(s, d, "events"), 3, 86_400_000_000)


# ---------------------------------------------------------------- adaptive
def _typed(s, d):
    v = X.vertices(s, d).select("entity_name", F.when(F.col("entity_type") == "ECONOMY", "OTHER").otherwise(F.col("entity_type")).alias("t"))
    p = graph.clique_expansion(X.edges(s, d).where("arity = 2")).select("edge_key", "a", "b")
    p = p.join(v.select(F.col("entity_name").alias("a"), F.col("t").alias("type_a")), "a").join(v.select(F.col("entity_name").alias("b"), F.col("t").alias("type_b")), "b")
    return p.select("edge_key", F.lit("near").alias("relation"), "type_a", "type_b")


@register
def typed_validity(s, d):
    rules = s.createDataFrame([("close", "near")], "relation string, canonical string")
    ok = table(s, d, "part").select(F.lit("near").alias("relation"), F.col("p_type").alias("type_a"), F.col("p_type").alias("type_b")).distinct()
    return adaptive.typed_validity(_typed(s, d), ok, rules).select("edge_key", "type_a", "type_b", "schema_validity")


@register
def router(s, d):
    rules = [("\\bthe\\b", "definition"), ("\\bof\\b", "relation"), ("\\band\\b", "comparison")]
    q = table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    r = adaptive.route(q, rules)
    return r.select("conv_id", "turn", "query_type", "complexity", adaptive.plan_for(F.col("complexity"))["k"].alias("k"))


@register
def soft_weight_topk(s, d):
    hits = X.entity_hits(s, d, 12).join(X.vertices(s, d).select("entity_name", "entity_type"), "entity_name")
    return adaptive.soft_weight(hits, ["PROMO", "STANDARD"]).select("entity_name", "sim", "soft_sim")


@register
def diffusion_weight(s, d):
    seeds = s.createDataFrame([("p7",), ("p11",)], "entity_name string")
    return adaptive.diffusion(X.edges(s, d, True), seeds).select("entity_name", "hop", "diffusion")


@register
def edge_quality(s, d):
    seeds = s.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#3",)], "entity_name string")
    q = adaptive.roles(adaptive.edge_quality(X.edges(s, d), seeds, ["PROMO"], X.vertices(s, d)))
    return q.select("edge_key", "quality", "hit", "role")


@register
def edge_quality_full(s, d):
    """All terms of an edge's quality: keywords, degree and hop too."""
    seeds = s.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#3",)], "entity_name string")
    near = X.entity_hits(s, d, 12).select("entity_name", F.lit(0).alias("hop"))
    wt = {"cover": 0.3, "source": 0.1, "arity": 0.1, "keyword": 0.1, "degree": 0.1, "hop": 0.1}
    q = adaptive.edge_quality(X.edges(s, d), seeds, ["PROMO"], X.vertices(s, d), weights=wt, near=near, keywords=["F", "P"], high_degree=1500)
    return adaptive.roles(q).select("edge_key", "quality", "hit", "role")


@register
def typed_vector_text(s, d):
    v, e = X.vertices(s, d), X.edges(s, d)
    ents = merge.entity_vector_text(v, typed=True).select("id", F.md5("text").alias("text"))
    return ents.unionByName(merge.edge_vector_text(e, v).select("id", F.md5("text").alias("text")))


@register
def ablation_modes(s, d):
    e, v, hits = X.edges(s, d), X.vertices(s, d), X.entity_hits(s, d, 12).select("entity_name", "sim")
    parts = [adaptive.ablated(e, hits, ["PROMO", "STANDARD"], v, c) for c in ("naive", "original", "typed", "full")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register
def validity_ratios(s, d):
    kind = F.when(F.col("p_type") == "ECONOMY", "OTHER").otherwise(F.col("p_type"))
    rows = table(s, d, "part").select(kind.alias("type_a"), F.lit("X").alias("type_b"), F.when(F.col("p_size") > 45, "invalid").otherwise("valid").alias("schema_validity"))
    return adaptive.validity_ratios(rows)


# ------------------------------------------------- evaluation, cache, texts
@register
def zip_by_position(s, d):
    left = table(s, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("pos"), F.md5("text").alias("q"))
    return evaluate.zip_by_position(left, table(s, d, "labels").select(F.col("doc_id").alias("pos"), F.col("quality").alias("r")))


@register
def cached_pieces(s, d):
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", F.posexplode(cache.pieces(F.col("text"))).alias("pos", "p")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.md5("p").alias("piece"))


@register
def round_robin(s, d):
    return table(s, d, "events").select("event_id", cache.round_robin(F.col("event_id"), 3).cast("long").alias("model"))


@register
def answer_clean(s, d):
    said = F.concat(F.lit("user ask me "), "text", F.lit("<x>"))
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(T.clean_answer(said, F.lit("ask me"), ["user", "<x>"])).alias("answer"))


@register
def question_parse(s, d):
    body = F.concat(F.lit('sure: {"Question": "what is '), F.col("doc_id").cast("string"), F.lit('?"'), F.when(F.col("doc_id") % 2 == 0, "}").otherwise(", broken"))
    return table(s, d, "documents").select("doc_id", T.question_of(body).alias("question"))


@register
def csv_parse(s, d):
    said = F.concat(F.lit('say "'), "p_type", F.lit('", twice'))
    rows = table(s, d, "part").select("p_partkey", T.csv_fields(T.csv_row(F.col("p_name"), said.alias("s")), 2).alias("f"))
    return rows.select("p_partkey", F.col("f")[0].alias("name"), F.col("f")[1].alias("said"))


@register
def edge_id_split(s, d):
    m = T.edge_members(F.array_join("entity_set", T.LIST_SEP))
    return X.edges(s, d).select("edge_key", F.size(m).alias("n"), m[0].alias("first"))


@register
def url_names(s, d):
    return table(s, d, "pages").select("page_id", T.url_name(F.replace("url", F.lit("/"), F.lit("%20"))).alias("name"))


@register
def embed_cut(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.embeddable(F.col("text"))).alias("cut"))


@register
def progress_percent(s, d):
    e = table(s, d, "events")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", T.percent(F.col("n"), F.lit(e.count())).alias("percent"))


@register
def vertex_payload(s, d):
    v, _ = graph.neighborhood(X.vertices(s, d), X.edges(s, d), "Brand#7")
    return v.select("entity_name", "entity_type", F.md5("description").alias("description"), F.size(F.split("source_id", T.quote(T.SEP))).alias("n_sources"))


@register
def summarise_long(s, d):
    def shorter(rows, col):
        return rows.withColumn(col, F.concat(F.lit("about "), F.length(col).cast("string")))

    out = merge.summarise(X.vertices(s, d), "description", 150, shorter)
    return out.select("entity_name", F.md5(F.array_join("description", T.SEP)).alias("description"))
