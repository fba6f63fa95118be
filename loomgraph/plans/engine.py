"""The engine: ingest into a store, and the five query modes (ids Q1-Q6, X1-X17, C1-C5, N3, K9, I13).

``embed`` (texts to vectors), ``extract`` (chunk to records), ``llm`` (prompt to answer),
``stream`` (prompt to pieces of the answer as they come) and ``summary`` (long text to a
shorter one, or None to keep it) are callables; the defaults are deterministic and need no
network.  An insert writes what it adds or changes, and embeds only that.  Answers are
cached in the store by model and prompt.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import extract as X
from loomgraph.operators import adaptive, ingest, merge, rank, vector
from loomgraph.operators import retrieve as R
from loomgraph.schema import TABLES, QueryParam
from loomgraph.session import importable
from loomgraph.sources.store import Store

#: Fixed value: the answer when nothing was found.
FAILURE = "Sorry, I'm not able to provide an answer to that question."


#: Tokens from which a merged text is summarised.
SUMMARY_TOKENS = {"description": 500, "additional_properties": 250}
EDGE_SUMMARY_TOKENS = {"description": 750, "keywords": 100}


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """A deterministic bag-of-words vector of unit length."""
    v = [0.0] * dim
    for w in text.lower().split():
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


@dataclass
class Answer:
    """The evidence of a question and the model's answer (None if only context was asked)."""

    context: str
    entities: list[dict]
    hyperedges: list[dict]
    text_units: list[dict]
    response: str | None = None


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        *,
        embed: Callable[[str], list[float]] = hashed_embedding,
        extract: Callable[[str, str | None], str] | None = None,
        llm: Callable[[str], str | None] | None = None,
        stream: Callable[[str], Iterator[str]] | None = None,
        summary: Callable[[str], str | None] | None = None,
        progress: Callable[[dict], None] | None = None,
        model: str = "default",
        cache: bool = True,
        typed: bool = False,
        rules: list[tuple[str, str]] | None = None,
        chunk_size: int = 1200,
        chunk_overlap: int = 100,
        max_gleaning: int = 1,
    ):
        importable(spark)
        self.spark, self.store = spark, Store(spark, path)
        self.embed, self.llm = embed, llm or (lambda prompt: None)
        self.stream, self.summary, self.progress = stream, summary, progress or (lambda event: None)
        self.model, self.cache, self.typed, self.rules = model, cache, typed, rules or []
        self.extractor = extract or (lambda content, before: content if before is None else "")
        self.chunk_size, self.chunk_overlap, self.max_gleaning = chunk_size, chunk_overlap, max_gleaning

    # ------------------------------------------------------------ writing
    def _embedded(self, df: DataFrame, schema: str) -> DataFrame:
        """``df`` (..., text) with ``text`` replaced by its embedding, in Arrow batches."""
        embed = self.embed

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.drop(columns="text").assign(embedding=[embed(t) for t in b["text"]])

        return df.mapInPandas(run, schema)

    def _summarised(self, df: DataFrame, limits: dict[str, int]) -> DataFrame:
        """``df`` with its long merged texts summarised; without a summary all are kept."""
        if self.summary is None:
            return df
        shorter = self.summary

        def rewrite(rows: DataFrame, col: str) -> DataFrame:
            said = F.pandas_udf(lambda texts: texts.map(shorter), "string")
            return rows.withColumn(col, said(col))

        for col, limit in limits.items():
            df = merge.summarise(df, col, limit, rewrite)
        return df

    def insert(self, docs: DataFrame, text_col: str = "content") -> int:
        """Adds documents that are new by content; returns how many.  All tables change together.

        Documents of which nothing is extracted (no entity or no hyperedge) change nothing."""
        s = self.store
        held: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            held.append(df.cache())
            return held[-1]

        try:
            fresh = keep(ingest.new_rows(ingest.doc_ids(docs, text_col), s.read("docs"), "doc_id"))
            n = fresh.count()
            if not n:
                return 0
            self.progress({"step": "documents", "new": n})
            chunks = ingest.last_wins(ingest.chunk_windows(fresh, self.chunk_size, self.chunk_overlap))
            chunks = keep(ingest.new_rows(chunks, s.read("chunks"), "chunk_id"))
            recs = keep(X.records(X.extract(chunks, self.extractor, self.max_gleaning)))
            ents, rels = X.entities(recs), X.hyperedges(recs)
            self.progress({"step": "extraction", **X.progress(ents, rels).first().asDict()})
            if ents.isEmpty() or rels.isEmpty():
                self.progress({"step": "nothing extracted"})
                return 0
            # stored rows take part in a merge where their key comes up again
            rels = rels.withColumn("edge_key", T.edge_key(F.col("members")))
            vertices = keep(self._summarised(merge.merge_entities(ents, s.read("vertices", ents)), SUMMARY_TOKENS))
            edges = keep(self._summarised(merge.merge_edges(rels, s.read("edges", rels)), EDGE_SUMMARY_TOKENS))
            members = edges.select(F.explode("entity_set").alias("entity_name"))
            known = vertices.select("entity_name").unionByName(s.read("vertices", members).select("entity_name"))
            vertices = keep(vertices.unionByName(merge.unknown_stubs(known, edges)))
            types = vertices.select("entity_name", "entity_type").unionByName(s.read("vertices", members).join(vertices, "entity_name", "left_anti").select("entity_name", "entity_type"))
            entity_text = merge.entity_vector_text(vertices, self.typed)
            edge_text = merge.edge_vector_text(edges, types if self.typed else None)
            chunk_text = chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
            s.commit(
                append={"docs": fresh, "chunks": chunks, "vec_chunks": self._embedded(chunk_text, "id string, embedding array<float>")},
                upsert={
                    "vertices": vertices,
                    "edges": edges,
                    "vec_entities": keep(self._embedded(entity_text, "id string, entity_name string, embedding array<float>")),
                    "vec_edges": keep(self._embedded(edge_text, "id string, edge_key string, embedding array<float>")),
                },
            )
            self.progress({"step": "stored", "new": n})
            return n
        finally:
            for df in held:
                df.unpersist()

    def _reembed(self, vertex: DataFrame | None = None, edge: DataFrame | None = None) -> None:
        new = {}
        if vertex is not None:
            new["vec_entities"] = self._embedded(merge.entity_vector_text(vertex, self.typed), "id string, entity_name string, embedding array<float>")
        if edge is not None:
            types = self.store.read("vertices") if self.typed else None
            new["vec_edges"] = self._embedded(merge.edge_vector_text(edge, types), "id string, edge_key string, embedding array<float>")
        self.store.commit(upsert=new)

    def create_vertex(self, name: str, **fields) -> None:
        """A new vertex with its vector; an existing one is an error."""
        self._reembed(vertex=self.store.create_vertex(name, **fields))

    def create_edge(self, members: list[str], **fields) -> None:
        """A new hyperedge with its vector; an existing one or an unknown member is an error."""
        self._reembed(edge=self.store.create_edge(members, **fields))

    def update_vertex(self, name: str, **fields) -> None:
        self._reembed(vertex=self.store.update_vertex(name, **fields))

    def update_edge(self, members: list[str], **fields) -> None:
        self._reembed(edge=self.store.update_edge(members, **fields))

    def status(self) -> dict[str, int]:
        """Rows of every table."""
        return self.store.counts()

    def reset(self) -> None:
        """Empties the database."""
        self.store.drop()

    # ------------------------------------------------------------ reading
    def graph(self) -> R.Graph:
        return R.Graph(self.store.read("vertices"), self.store.read("edges"), self.store.read("chunks").select("chunk_id", "content"))

    def _hits(self, table: str, question: str, key: str, p: QueryParam) -> DataFrame:
        top = vector.top_k(self.store.read(table), self.embed(question), p.top_k, p.threshold)
        return rank.ranked(top, "rank", [F.desc("sim"), F.asc("id")]).select("rank", F.col(key).alias("chunk_id" if key == "id" else key))

    def entity_line(self, question: str, p: QueryParam) -> tuple[DataFrame, DataFrame, DataFrame]:
        g, hits = self.graph(), self._hits("vec_entities", question, "entity_name", p)
        v = R.entity_hits(g, hits).withColumn("pos", F.col("rank"))
        e = rank.ranked(R.entity_edges(g, hits, p.max_token_for_relation_context), "pos", rank.edge_order())
        c = rank.ranked(R.entity_chunks(g, hits, p.max_token_for_text_unit), "pos", [F.asc("rank"), F.desc("relation_counts"), F.asc("chunk_id")])
        return v, e, c

    def relation_line(self, question: str, p: QueryParam, pairs_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        g, hits = self.graph(), self._hits("vec_edges", question, "edge_key", p)
        if pairs_only:
            hits = R.pairwise(hits, g.edges).select("rank", "edge_key")
        e = R.relation_edges(g, hits, p.max_token_for_relation_context)
        return R.relation_entities(g, e, p.max_token_for_entity_context), e, R.relation_chunks(g, e, p.max_token_for_text_unit)

    def keywords(self, question: str) -> tuple[str, str]:
        """High- and low-level keywords by the model, or the question itself where it has none."""
        said = self._said(f"Give high_level_keywords and low_level_keywords as JSON for: {question}")
        if said is None:
            return question, question
        row = self.spark.createDataFrame([(said,)], "a string").select(T.keywords(F.col("a")).alias("k")).first()["k"]
        return (row["high"], row["low"]) if row else ("", "")

    def context(self, question: str, p: QueryParam) -> Answer:
        """The evidence of a question in its mode; lazy plans, collected once a section."""
        if p.mode == "llm":
            return Answer("", [], [], [])
        if p.mode == "naive":
            hits = self._hits("vec_chunks", question, "id", p)
            chunks = self.store.read("chunks")
            text = R.chunk_context(hits, chunks, p.max_token_for_text_unit).first()["context"]
            return Answer(text, [], [], [])
        high, low = self.keywords(question)
        lines = []
        if p.mode in ("hyper", "hyper-lite") and low:
            lines.append(self.entity_line(low, p))
        if p.mode in ("hyper", "graph") and high:
            lines.append(self.relation_line(high, p, pairs_only=p.mode == "graph"))
        if not lines:
            return Answer("", [], [], [])
        out = []
        for i, (key, cols) in enumerate((("entity_name", ["entity_type", "description"]), ("edge_key", ["entity_set", "description", "keywords", "weight", "arity"]), ("chunk_id", ["content"]))):
            parts = [line[i].select(key, *cols, "pos") for line in lines]
            both = R.combine(parts[0], parts[1], key) if len(parts) == 2 else rank.ranked(parts[0], "id", [F.asc("pos")], start=1)
            out.append(both.orderBy("id").drop("pos"))
        rows = [[r.asDict(recursive=True) for r in df.collect()] for df in out]  # cut by the budgets
        if not any(rows):
            return Answer("", [], [], [])
        names = ("Entities", "Relationships", "Sources")
        text = "\n".join(f"-----{n}-----\n{self._csv(df)}" for n, df in zip(names, out, strict=True))
        return Answer(text, *rows)

    def _csv(self, df: DataFrame) -> str:
        cols = [F.array_join(c, T.SEP).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes if c != "id"]
        lines = df.orderBy("id").select(T.csv_row("id", *cols).alias("x")).collect()
        return "\r\n".join([",".join(["id", *[c for c in df.columns if c != "id"]]), *[r["x"] for r in lines]])

    # ------------------------------------------------------------ answers
    def _hash(self, prompt: str) -> str:
        return hashlib.md5(json.dumps([self.model, prompt], ensure_ascii=False).encode()).hexdigest()

    def _cached(self, prompt: str) -> str | None:
        if not self.cache:
            return None
        row = self.store.read("llm_cache").where(F.col("args_hash") == self._hash(prompt)).first()
        return row["return"] if row else None

    def _remember(self, prompt: str, said: str) -> None:
        if self.cache:
            row = self.spark.createDataFrame([(self._hash(prompt), self.model, said)], TABLES["llm_cache"])
            self.store.commit(append={"llm_cache": row})

    def _said(self, prompt: str) -> str | None:
        """The model's answer, from the cache where it was given before."""
        said = self._cached(prompt)
        if said is None:
            said = self.llm(prompt)
            if said is not None:
                self._remember(prompt, said)
        return said

    def _prompt(self, question: str, p: QueryParam, context: str) -> str:
        if p.rag_define:
            high, low = self.keywords(question)
            question = f"{question}\nKeywords: {high}; {low}"
        return f"---Length and form of the answer---\n{p.response_type}\n---Evidence---\n{context}\n---Question---\n{question}"

    def _clean(self, said: str | None, prompt: str, question: str) -> str | None:
        """An answer without the prompt that some models repeat."""
        if said is None or len(said) <= len(prompt):
            return said
        row = self.spark.createDataFrame([(said, prompt)], "a string, p string")
        return row.select(T.clean_answer(F.col("a"), F.col("p"), ["user", "model", question, "<system>", "</system>"]).alias("a")).first()["a"]

    def routed(self, question: str, p: QueryParam) -> QueryParam:
        """The parameters that the question's complexity asks for; unchanged without rules."""
        if not self.rules:
            return p
        row = adaptive.route(self.spark.createDataFrame([(question,)], "question string"), self.rules)
        return replace(p, top_k=row.select(adaptive.plan_for(F.col("complexity"))["k"].alias("k")).first()["k"])

    def query(self, question: str, param: QueryParam | None = None) -> Answer:
        p = self.routed(question, param or QueryParam())
        a = self.context(question, p)
        if p.only_need_context:
            return a
        if not a.context and p.mode != "llm":
            a.response = FAILURE
            return a
        prompt = self._prompt(question, p, a.context)
        a.response = self._clean(self._said(prompt), prompt, question)
        return a

    def query_stream(self, question: str, param: QueryParam | None = None, size: int = 32) -> Iterator[str]:
        """The answer's pieces as the model gives them; a cached answer, or that of a model without
        a stream, is replayed in pieces of ``size`` characters.  Pairwise mode has no stream."""
        p = self.routed(question, param or QueryParam())
        if p.mode == "graph":
            raise ValueError("graph mode cannot be streamed")
        a = self.context(question, p)
        if not a.context and p.mode != "llm":
            yield FAILURE
            return
        prompt = self._prompt(question, p, a.context)
        said = self._cached(prompt)
        if said is None and self.stream is not None:
            parts = []
            for piece in self.stream(prompt):
                parts.append(piece)
                yield piece
            self._remember(prompt, "".join(parts))
            return
        said = said if said is not None else self._said(prompt) or ""
        yield from (said[i : i + size] for i in range(0, len(said), size))
