"""The engine end to end: ingest, modes, store, streams."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.plans.engine import FAILURE, Engine
from loomgraph.schema import QueryParam
from loomgraph.sources import readers
from loomgraph.sources.store import Store, databases
from loomgraph.streaming.ingest import ingest
from loomgraph.streaming.rate_limit import limit_batch, limit_stream

DOC = '("Entity" | alice | person | a doctor | old) <|COMPLETE|> ("Entity" | bob | person | a patient | young) <|COMPLETE|> ("Low-order Hyperedge" | alice | bob | treats | care | 2) <|COMPLETE|> ("High-order Hyperedge" | alice | bob | carol | a ward | gen | care | 1)'


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("db") / "one"), chunk_size=200, chunk_overlap=20, llm=lambda p: "said: " + p[-20:] if p.startswith("---") else None)
    assert e.insert(spark.createDataFrame([(DOC,), (DOC,)], "content string")) == 1
    return e


def test_ingest_is_idempotent(engine, spark):
    before = {r.edge_key: r.weight for r in engine.store.read("edges").collect()}
    assert engine.insert(spark.createDataFrame([(DOC,)], "content string")) == 0
    assert {r.edge_key: r.weight for r in engine.store.read("edges").collect()} == before == {"ALICE|#|BOB": 2.0, "ALICE|#|BOB|#|CAROL": 1.0}
    kinds = {r.entity_name: r.entity_type for r in engine.store.read("vertices").collect()}
    assert kinds == {"ALICE": "PERSON", "BOB": "PERSON", "CAROL": "UNKNOWN"}
    assert engine.store.read("vec_entities").count() == 2


@pytest.mark.parametrize("mode", ["hyper", "hyper-lite", "graph", "naive", "llm"])
def test_modes(engine, mode):
    a = engine.query("alice a doctor ALICEa doctor", QueryParam(mode=mode, threshold=0.0))
    assert a.response.startswith("said")
    if mode == "hyper":
        assert {r["entity_name"] for r in a.entities} == {"ALICE", "BOB", "CAROL"}
        assert len(a.hyperedges) == 2 and len(a.text_units) == 1
    if mode == "graph":
        assert [r["edge_key"] for r in a.hyperedges] == ["ALICE|#|BOB"]


def test_long_merged_texts_are_summarised(spark, tmp_path):
    w = lambda n: " ".join(["word"] * n)
    doc = f'("Entity" | alice | person | {w(500)} | {w(250)}) <|COMPLETE|> ("Entity" | bob | person | {w(499)} | {w(249)}) <|COMPLETE|> ("Low-order Hyperedge" | alice | bob | {w(750)} | {w(100)} | 2)'
    short = Engine(spark, str(tmp_path / "sum"), chunk_size=9000, summary=lambda t: f"short {len(t.split())}")
    assert short.insert(spark.createDataFrame([(doc,)], "content string")) == 1
    v = {r.entity_name: (r.description, r.additional_properties) for r in short.store.read("vertices").collect()}
    assert v == {"ALICE": (["short 500"], ["short 250"]), "BOB": ([w(499)], [w(249)])}
    assert [(r.description, r.keywords) for r in short.store.read("edges").collect()] == [(["short 750"], ["short 100"])]


def test_nothing_found_and_streams(engine):
    assert engine.query("zzz", QueryParam(threshold=1.1)).response == FAILURE
    assert "".join(engine.query_stream("alice", QueryParam(threshold=0.0))).startswith("said")
    with pytest.raises(ValueError):
        next(engine.query_stream("alice", QueryParam(mode="graph")))
    with pytest.raises(ValueError):
        QueryParam(mode="other")


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    assert s.read("docs").count() == 0
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, content string")
    s.commit({"docs": rows})
    s.commit({"docs": s.add("docs", "doc_id", spark.createDataFrame([("a", "9"), ("c", "3")], "doc_id string, content string"))})
    assert {tuple(r) for r in s.read("docs").collect()} == {("a", "1"), ("b", "2"), ("c", "3")}
    assert [tuple(r) for r in s.get("docs", "doc_id", ["c", "x"]).collect()] == [("c", "3"), ("x", None)]
    s.vacuum()
    assert s.read("docs").count() == 3 and databases(spark, str(tmp_path)) == ["db"]


def test_delete_vertex_cascades(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.insert(spark.createDataFrame([(DOC,)], "content string"))
    e.store.delete_vertices(["BOB"])
    assert [r.edge_key for r in e.store.read("edges").collect()] == ["ALICE|#|CAROL"]
    assert {r.entity_name for r in e.store.read("vec_entities").collect()} == {"ALICE"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"context": "x"}\n\nbad\n{"context": " "}\n[1]\n')
    assert [r.context for r in readers.jsonl_contexts(spark, str(tmp_path)).collect()] == ["x"]
    (tmp_path / "b.json").write_text(json.dumps(["p", "q"]))
    assert [tuple(r) for r in readers.json_strings(spark, str(tmp_path / "b.json")).collect()] == [(0, "p"), (1, "q")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "c.md").write_text("# hi")
    assert [r.content for r in readers.documents(spark, str(tmp_path / "t")).collect()] == ["# hi"]
    (tmp_path / "g.xml").write_text('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph><node id="&quot;A&quot;"><data key="d0">T</data></node><edge source="A" target="B"><data key="d3">x</data></edge></graph></graphml>')
    n, e = readers.graphml(spark, str(tmp_path / "g.xml"))
    assert (n.first().id, n.first().entity_type) == ("A", "T") and e.first().weight == 0.0


def test_rate_limit(spark, tmp_path):
    rows = [(1, i, t) for i, t in enumerate((0.0, 0.1, 0.2, 0.3, 1.0))]
    ev = spark.createDataFrame(rows, "user_id long, event_id long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    assert tuple(limit_batch(ev).first()) == (1, 5, 1)
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = limit_stream(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.allowed for r in spark.table("limited").orderBy("ts").collect()] == [True, True, True, False, True]


def test_streaming_ingest(spark, tmp_path):
    spark.createDataFrame([(DOC,)], "content string").write.parquet(str(tmp_path / "in"))
    e = Engine(spark, str(tmp_path / "db"))
    ingest(spark.readStream.schema("content string").parquet(str(tmp_path / "in")), e, str(tmp_path / "cp")).awaitTermination(180)
    assert e.store.read("docs").count() == 1


def test_inserts_touch_only_what_changes(spark, tmp_path):
    seen = []
    e = Engine(spark, str(tmp_path / "db"), embed=lambda t: seen.append(t) or [1.0], progress=lambda x: seen.append(x["step"]))
    other = '("Entity" | dave | person | a nurse | new) <|COMPLETE|> ("Low-order Hyperedge" | dave | alice | helps | care | 1)'
    assert e.insert(spark.createDataFrame([(DOC,)], "content string")) == 1
    before = e.store.manifest()
    assert e.insert(spark.createDataFrame([(other,)], "content string")) == 1
    after = e.store.manifest()
    assert set(before["docs"]) < set(after["docs"])
    assert sum(before["edges"].get(b) == f for b, f in after["edges"].items()) >= 1
    assert "nothing extracted" not in seen and "stored" in seen
    assert e.store.vertex("ALICE")["entity_type"] == "PERSON" and e.store.vertex("NOBODY") is None
    assert e.store.edge(["BOB", "ALICE", "CAROL"])["generalization"] == ["gen"]
    assert e.store.edge(["BOB", "ALICE", "CAROL"])["level_hg"] == "high"
    assert e.insert(spark.createDataFrame([("no records here",)], "content string")) == 0
    assert e.status()["docs"] == 2 and e.status()["vec_entities"] == 3
    e.store.compact("docs")
    e.store.vacuum()
    assert e.status()["docs"] == 2
    e.reset()
    assert e.status()["docs"] == 0


def test_guarded_changes(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.insert(spark.createDataFrame([(DOC,)], "content string"))
    with pytest.raises(ValueError):
        e.create_vertex("ALICE")
    with pytest.raises(ValueError):
        e.create_edge(["ALICE", "ZOE"])
    with pytest.raises(ValueError):
        e.create_edge(["BOB", "ALICE"])
    with pytest.raises(KeyError):
        e.update_vertex("ZOE", entity_type="X")
    with pytest.raises(KeyError):
        e.store.delete_edge(["ALICE", "ZOE"])
    e.create_vertex("ZOE", entity_type="PERSON", description="a visitor")
    e.create_edge(["ZOE", "ALICE"], keywords=["visit"], weight=3.0)
    e.update_vertex("ZOE", entity_type="GUEST", description="")
    assert (e.store.vertex("ZOE")["entity_type"], e.store.vertex("ZOE")["description"]) == ("GUEST", ["a visitor"])
    assert e.store.edge(["ALICE", "ZOE"])["weight"] == 3.0
    e.store.delete_edge(["ALICE", "ZOE"])
    assert e.store.edge(["ALICE", "ZOE"]) is None
    assert e.store.read("vec_entities").where("entity_name = 'ZOE'").count() == 1


def test_answers_are_cached_and_streams_live(spark, tmp_path):
    asked = []
    e = Engine(spark, str(tmp_path / "db"), llm=lambda p: asked.append(p) or "x" * 70, stream=lambda p: iter(["a", "bc"]))
    assert e.query("q", QueryParam(mode="llm")).response == "x" * 70
    assert e.query("q", QueryParam(mode="llm")).response == "x" * 70 and len(asked) == 1
    assert [len(x) for x in e.query_stream("q", QueryParam(mode="llm"))] == [32, 32, 6]
    assert list(e.query_stream("other", QueryParam(mode="llm"))) == ["a", "bc"]
    assert list(e.query_stream("other", QueryParam(mode="llm"))) == ["abc"]


def test_routing_and_keywords_in_the_question(spark, tmp_path):
    asked = []
    e = Engine(spark, str(tmp_path / "db"), llm=lambda p: asked.append(p), rules=[("why", "cause"), ("how", "way")])
    assert e.routed("why and how", QueryParam()).top_k == 60 and e.routed("hm", QueryParam()).top_k == 20
    e.query("why", QueryParam(mode="llm", rag_define=True))
    assert "Keywords: why; why" in asked[-1]


def test_files(spark, tmp_path):
    from loomgraph.sources.files import Files

    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "one.md").write_text(DOC)
    (tmp_path / "up" / "two.bin").write_text("?")
    e = Engine(spark, str(tmp_path / "db"))
    f = Files(e)
    row = f.add(str(tmp_path / "up")).collect()
    assert [(r.filename, r.status, r.database) for r in row] == [("one.md", "uploaded", "one")]
    assert f.add(str(tmp_path / "up")).count() == 1 and f.listed().count() == 1
    assert f.embed([row[0].file_id]) == 1 and f.listed().first().status == "embedded"
    assert e.status()["vertices"] == 3
    f.delete([row[0].file_id])
    assert f.listed().count() == 0 and f.embed([]) == 0
    with pytest.raises(Exception, match="unsupported"):
        readers.documents(spark, str(tmp_path / "up")).collect()


def test_writers(spark, tmp_path):
    from loomgraph.sources import writers

    df = spark.createDataFrame([(1, "é", True), (2, None, False)], "a int, b string, ok boolean")
    writers.export_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert "é" in writers.json_text(df).where("a = 1").first()["json"]
    writers.write_outcomes(df, F.col("ok"), str(tmp_path / "ok"), str(tmp_path / "err"))
    assert spark.read.json(str(tmp_path / "ok")).count() == 1 == spark.read.json(str(tmp_path / "err")).count()
    one = spark.createDataFrame([("x",), ("x",), (None,)], "context string")
    writers.write_contexts(one, str(tmp_path / "c"))
    writers.write_contexts(spark.createDataFrame([("y",)], "context string"), str(tmp_path / "c"))
    assert [r.context for r in spark.read.json(str(tmp_path / "c")).collect()] == ["x"]


def test_docx(spark, tmp_path):
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    assert readers.documents(spark, str(tmp_path / "a.docx")).first().content == "one\ntwo"
