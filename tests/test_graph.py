"""Hypergraph operators against a small dictionary model, and hand-made cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph, merge, rank
from loomgraph.operators import extract as X
from loomgraph.operators import ingest

EDGE = "members array<string>, description string, keywords string, weight double, source_id string"


def make(spark, sets):
    rows = [(list(m), f"d{i}", "k", 1.0, f"c{i}") for i, m in enumerate(sets)]
    return merge.merge_edges(spark.createDataFrame(rows, EDGE))


@pytest.mark.parametrize("seed", range(3))
def test_random_graph(spark, seed):
    rng = random.Random(seed)
    sets = [tuple(rng.sample("abcdefgh", rng.randint(1, 4))) for _ in range(25)]
    e = make(spark, sets).cache()
    model = Counter(tuple(sorted(set(m))) for m in sets)
    assert {tuple(r.entity_set): r.weight for r in e.collect()} == dict(model)
    degree = Counter(v for m in model for v in m)
    assert {r.entity_name: r.degree for r in graph.vertex_degree(e).collect()} == dict(degree)
    near = {(a, b) for m in model for a in m for b in m if a != b}
    assert {tuple(r) for r in graph.neighbors(e).collect()} == near
    seeds = spark.createDataFrame([("a",)], "entity_name string")
    assert {tuple(r) for r in graph.neighbors(e, seeds).collect()} == {p for p in near if p[0] == "a"}
    dist = {"a": 0}
    for h in (1, 2):
        dist |= {b: h for a, b in near if dist.get(a) == h - 1 and b not in dist}
    assert {r.entity_name: r.hop for r in graph.hops(e, seeds).collect()} == dist
    v = spark.createDataFrame([(c, "T", ["d"], ["p"], ["s"]) for c in "abcdefgh"], "entity_name string, entity_type string, description array<string>, additional_properties array<string>, source_id array<string>")
    left, cut = graph.remove_vertices(v, e, ["a"])
    want = Counter()
    for m, w in model.items():
        rest = tuple(x for x in m if x != "a")
        if rest == m or len(rest) >= 2:
            want[rest] += w
    assert {tuple(r.entity_set): r.weight for r in cut.collect()} == dict(want)
    assert left.count() == 7
    e.unpersist()


def test_vote_ties_go_to_the_first_seen(spark):
    rows = [("x", "A", 0), ("x", "B", 1), ("y", "B", 0), ("y", "A", 1), ("y", "A", 2)]
    got = merge.vote_type(spark.createDataFrame(rows, "entity_name string, entity_type string, record_seq int"))
    assert {tuple(r) for r in got.collect()} == {("x", "A"), ("y", "A")}


def test_unknown_never_outvotes(spark):
    stored = spark.createDataFrame([("x", "UNKNOWN", ["UNKNOWN"], [], ["s0"])] , "entity_name string, entity_type string, description array<string>, additional_properties array<string>, source_id array<string>")
    new = spark.createDataFrame([("x", "CITY", "big", ["p"], "s1", 0)], "entity_name string, entity_type string, description string, additional_properties array<string>, source_id string, record_seq int")
    r = merge.merge_entities(new, stored).first()
    assert (r.entity_type, r.description, r.source_id) == ("CITY", ["big"], ["s0", "s1"])


def test_records(spark):
    text = "\n".join(
        [
            '("Entity" | paris &amp; co | city | a city | p1 | p2)<|COMPLETE|>',
            '("Entity" |  | city | nameless | p)',
            '("Low-order Hyperedge" | a | b | near | road | 5.)',
            '("High-order Hyperedge" | a | b | d | gen | kw | 0.5)',
            '("High-order Hyperedge" | a | d | gen | kw | 0.5)',
            '("Low-order Hyperedge" | a | a | same | k | 1)',
            "not a record",
        ]
    )
    recs = X.records(spark.createDataFrame([("c1", text)], "chunk_id string, output string"))
    e = X.entities(recs).collect()
    # the empty name is dropped as a field, so later fields shift
    assert [(r.entity_name, r.additional_properties) for r in e] == [("PARIS &AMP; CO".replace("&AMP;", "&"), ["p1", "p2"]), ("CITY", [])]
    h = {(tuple(r.members), r.level_hg, r.weight) for r in X.hyperedges(recs).collect()}
    assert h == {(("A", "B"), "low", 0.75), (("A", "B"), "high", 0.5), (("A",), "low", 1.0)}


def test_extract_gleans(spark):
    chunks = spark.createDataFrame([("c", "text")], "chunk_id string, content string")
    out = X.extract(chunks, lambda c, before: "(one)" if before is None else "(two)", 1).first()["output"]
    assert out == "(one)\n(two)"


def test_chunks(spark):
    docs = spark.createDataFrame([("d1", ""), ("d2", "a b c"), ("d3", " ".join("abcdefghij")), ("d4", None)], "doc_id string, content string")
    rows = ingest.chunk_windows(docs, 4, 1).orderBy("full_doc_id", "chunk_order_index").collect()
    assert [(r.full_doc_id, r.content, r.tokens) for r in rows] == [("d2", "a b c", 3), ("d3", "a b c d", 4), ("d3", "d e f g", 4), ("d3", "g h i j", 4), ("d3", "j", 1)]
    with pytest.raises(ValueError):
        ingest.chunk_windows(docs, 4, 4)


def test_token_budget(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d e f"), (4, "g")], "i int, t string")
    keep = lambda b: [r.i for r in rank.token_budget(df, "t", b, [F.asc("i")]).orderBy("i").collect()]
    assert keep(0) == [] and keep(1) == [] and keep(3) == [1, 2] and keep(6) == [1, 2, 3] and keep(99) == [1, 2, 3, 4]


def test_upsert_keeps_other_fields(spark):
    s = spark.createDataFrame([("a", "x", "y"), ("b", "x", "y")], "k string, f string, g string")
    n = spark.createDataFrame([("a", "new"), ("c", "z")], "k string, f string")
    assert {tuple(r) for r in graph.upsert(s, n, "k").collect()} == {("a", "new", "y"), ("b", "x", "y"), ("c", "z", None)}
    assert graph.upsert(s, n, "k", must_exist=True).count() == 2


def test_edge_key_is_canonical(spark):
    row = spark.createDataFrame([(["b", "a", "b"],)], "m array<string>").select(T.edge_key(F.col("m")).alias("k")).first()
    assert row.k == "a|#|b"
