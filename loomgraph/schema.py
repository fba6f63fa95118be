"""Schemas of the engine's tables and the query parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S, A = T.StringType(), T.ArrayType(T.StringType())


def _of(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TABLES = {
    "docs": _of(doc_id=S, content=S),
    "chunks": _of(chunk_id=S, full_doc_id=S, chunk_order_index=T.IntegerType(), tokens=T.IntegerType(), content=S),
    "vertices": _of(entity_name=S, entity_type=S, description=A, additional_properties=A, source_id=A),
    "edges": _of(edge_key=S, entity_set=A, description=A, keywords=A, source_id=A, weight=T.DoubleType(), arity=T.IntegerType(), generalization=A, level_hg=S),
    "vec_chunks": _of(id=S, embedding=T.ArrayType(T.FloatType())),
    "vec_entities": _of(id=S, entity_name=S, embedding=T.ArrayType(T.FloatType())),
    "vec_edges": _of(id=S, edge_key=S, embedding=T.ArrayType(T.FloatType())),
    "llm_cache": _of(args_hash=S, model=S, **{"return": S}),
    "files": _of(file_id=S, path=S, filename=S, database=S, status=S, size=T.LongType(), upload_time=T.TimestampType(), process_time=T.TimestampType(), hash=S),
}

#: Tables whose rows change, by key; all others only grow.
KEYS = {"vertices": "entity_name", "edges": "edge_key", "vec_entities": "entity_name", "vec_edges": "edge_key", "files": "file_id"}

#: Query modes, and the parameters with their defaults.
MODES = ("hyper", "hyper-lite", "graph", "naive", "llm")


@dataclass(frozen=True)
class QueryParam:
    mode: str = "hyper"
    only_need_context: bool = False
    response_type: str = "Multiple Paragraphs"
    rag_define: bool = False
    top_k: int = 60
    threshold: float = 0.2
    max_token_for_text_unit: int = 1600
    max_token_for_entity_context: int = 300
    max_token_for_relation_context: int = 1600

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
