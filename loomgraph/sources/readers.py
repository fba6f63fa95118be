"""Sources (ids S1-S14): text, JSON, JSONL, PDF and DOCX, GraphML, file listings."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T

#: Readable extensions (``.doc`` is refused: it has no reader).
READABLE = (".txt", ".md", ".pdf", ".docx")
MIME = ("text/plain", "text/markdown", "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")


def accepted(name_col: str, mime_col: str | None = None):
    """Whether a file is of a readable type, by extension or by MIME type."""
    ext = F.concat(F.lit("."), F.lower(F.substring_index(name_col, ".", -1))).isin(list(READABLE))
    return ext if mime_col is None else ext | F.col(mime_col).isin(list(MIME))


def jsonl_contexts(spark: SparkSession, path: str, field: str = "context") -> DataFrame:
    """(context) of every line that is a JSON object with a non-blank text there; others are skipped."""
    lines = spark.read.text(path, pathGlobFilter="*.jsonl").where(F.trim("value") != "")
    return lines.select(F.get_json_object("value", f"$.{field}").alias("context")).where(T.strip(F.col("context")) != "")


def jsonl_violations(lines: DataFrame, field: str = "context", col: str = "value") -> DataFrame:
    """Each line's violation: null (fine), bad_json, not_object or empty_context; blank lines are skipped."""
    v = F.try_parse_json(col)
    body = F.get_json_object(col, f"$.{field}")
    bad = (
        F.when(v.isNull(), "bad_json")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "not_object")
        .when(body.isNull() | (T.strip(body) == ""), "empty_context")
    )
    return lines.where(F.trim(col) != "").withColumn("violation", bad)


def jsonl_report(lines: DataFrame, **options) -> DataFrame:
    """Counts by violation in one row."""
    v = jsonl_violations(lines, **options)
    kinds = [F.count_if(F.col("violation") == k).alias(f"n_{k}") for k in ("bad_json", "not_object", "empty_context")]
    return v.agg(F.count("*").alias("n_rows"), *kinds)


def json_strings(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of a JSON array of strings."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "value"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): whole .txt, .md and other text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _docx(data: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def _pdf(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pypdf") from e
    return "".join((p.extract_text() or "") + "\n" for p in PdfReader(io.BytesIO(data)).pages)


def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content, hash, size) of .txt, .md, .pdf and .docx files; other types raise."""
    files = spark.read.format("binaryFile").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, data in zip(b["path"], b["content"], strict=True):
                ext = "." + p.rsplit(".", 1)[-1].lower()
                if ext in (".txt", ".md"):
                    out.append(data.decode("utf-8"))
                elif ext == ".docx":
                    out.append(_docx(data))
                elif ext == ".pdf":
                    out.append(_pdf(data))
                else:
                    raise ValueError(f"unsupported file type {ext}")
            yield pd.DataFrame({"path": b["path"], "content": out, "hash": b["hash"], "size": b["size"]})

    rows = files.select("path", "content", F.md5("content").alias("hash"), F.col("length").alias("size"))
    return rows.mapInPandas(run, "path string, content string, hash string, size long")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML files; quotes are stripped, a missing weight is 0.0."""

    def rows(kind: str, keys: list[str], names: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ns = "{http://graphml.graphdrawing.org/xmlns}"
            for b in batches:
                out = []
                for text in b["value"]:
                    for n in ElementTree.fromstring(text).iter(f"{ns}{kind}"):
                        data = {d.get("key"): (d.text or "").strip('"') for d in n.iter(f"{ns}data")}
                        ids = [(n.get(a) or "").strip('"') for a in (["id"] if kind == "node" else ["source", "target"])]
                        out.append(ids + [data.get(k, "") for k in keys])
                yield pd.DataFrame(out, columns=names, dtype=str)

        return run

    whole = spark.read.text(path, wholetext=True)
    node = ["id", "entity_type", "description", "source_id"]
    edge = ["source", "target", "weight", "description", "keywords", "source_id"]
    nodes = whole.mapInPandas(rows("node", ["d0", "d1", "d2"], node), ", ".join(f"{n} string" for n in node))
    edges = whole.mapInPandas(rows("edge", ["d3", "d4", "d5", "d6"], edge), ", ".join(f"{n} string" for n in edge))
    return nodes, edges.withColumn("weight", F.coalesce(F.expr("try_cast(weight AS double)"), F.lit(0.0)))
