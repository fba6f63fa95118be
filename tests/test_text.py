"""Micro-cases of the text and parsing expressions."""

import csv
import io

from pyspark.sql import functions as F

from loomgraph.functions import text as T


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"`{k}` string" for k in cols))
    return row.select(expr.alias("x")).first()["x"]


def test_strip_and_clean(spark):
    for s in ("　a b ", "\x1fx\x85", "   ", "", "a"):
        assert one(spark, T.strip(F.col("s")), s=s) == s.strip()
    assert one(spark, T.clean(F.col("s")), s=" a &amp; b\x01\x9f ") == "a & b"
    assert one(spark, T.clean(F.col("s")), s=None) is None


def test_split_markers(spark):
    assert one(spark, T.split_markers(F.col("s"), ["|", "<E>"]), s=" a | |b<E> c <E>") == ["a", "b", "c"]


def test_record_body(spark):
    assert one(spark, T.record_body(F.col("s")), s='x("Entity" | a (b))y') == '"Entity" | a (b)'
    assert one(spark, T.record_body(F.col("s")), s="nothing") is None
    assert one(spark, T.record_body(F.col("s")), s="(a b)") == "a b"


def test_weight(spark):
    for s, w in (("2", 2.0), (".5", 0.5), ("-1.5", -1.5), ("5.", 0.75), ("1e3", 0.75), ("", 0.75), (None, 0.75)):
        assert one(spark, T.weight(F.col("s")), s=s) == w


def test_keywords(spark):
    k = T.keywords(F.col("s"))
    assert tuple(one(spark, k, s='pre {"high_level_keywords": ["a", "b"], "low_level_keywords": "c"} post')) == ("a, b", "c")
    assert tuple(one(spark, k, s='{"high_level_keywords": "h"} and } more')) == ("h", "")
    assert one(spark, k, s="none") is None


def test_csv_row_matches_the_writer(spark):
    for row in (["a", 'q"q', "x,y"], ["", " lead", "trail "], ["line\nbreak", "plain", "漢"]):
        out = io.StringIO()
        csv.writer(out).writerow(row)
        got = one(spark, T.csv_row(F.col("a"), F.col("b"), F.col("c")), a=row[0], b=row[1], c=row[2])
        assert list(csv.reader([got], strict=True))[0] == row if "\n" not in row[0] else got in out.getvalue()


def test_database_name(spark):
    for s, want in (("My Report 2024.pdf", "MyRep"), ("a.b.txt", "ab"), ("???.md", "default"), ("用户手册V1.0.md", "用户手册V")):
        assert one(spark, T.database_name(F.col("s")), s=s) == want


def test_judges_and_messages(spark):
    text = ", ".join(f'"Score": "{n}"' for n in range(7))
    assert one(spark, T.scores(F.col("s")), s=text) == [0, 1, 2, 3, 4]
    assert one(spark, T.winners(F.col("s")), s='{"Winner": "Answer 1"} {"Winner": "Answer 2"}') == ["answer 1", "answer 2"]
    assert one(spark, T.question_of(F.col("s")), s='so {"Question": "why?"}') == "why?"
    assert one(spark, T.before_sources(F.col("s")), s="a-----Sources-----b") == "a"
    got = one(spark, T.pack_messages(F.array("a", "b", "c")), a="x", b="y", c="z")
    assert [(m["role"], m["content"]) for m in got] == [("user", "x"), ("assistant", "y"), ("user", "z")]


def test_small_text_helpers(spark):
    import base64
    import struct
    import time

    vec = base64.b64encode(struct.pack("<2f", 1.5, -2.0)).decode()
    row = spark.createDataFrame([(vec, "-----Entities-----\na,b\n-----Sources-----\nx", "a" + " " * 200_000 + "b")], "v string, c string, s string")
    began = time.time()
    got = row.select(
        T.packed_vector(F.col("v")).alias("v"), T.section(F.col("c"), "Entities").alias("e"), T.section(F.col("c"), "Sources").alias("s"), T.section(F.col("c"), "No").alias("n"), F.length(T.strip(F.col("s"))).alias("k")
    ).first()
    assert (got.v, got.e, got.s, got.n, got.k) == ([1.5, -2.0], "a,b", "x", None, 200_002)
    assert time.time() - began < 20
