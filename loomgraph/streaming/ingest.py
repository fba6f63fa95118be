"""Streaming ingest: every micro-batch is merged like a batch insert (idempotent by content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomgraph.plans.engine import Engine


def ingest(docs: DataFrame, engine: Engine, checkpoint: str, text_col: str = "content", **trigger) -> StreamingQuery:
    """Starts a query that inserts a streaming table of documents; a replayed batch adds nothing."""

    def merge(batch: DataFrame, _epoch: int) -> None:
        engine.insert(batch, text_col)

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
