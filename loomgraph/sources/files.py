"""The file registry: uploads, their status, and embedding into a graph (ids I14, L7, X25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.plans.engine import Engine
from loomgraph.sources import readers


class Files:
    """The files of one database; the engine's store keeps their rows."""

    def __init__(self, engine: Engine):
        self.engine, self.store, self.spark = engine, engine.store, engine.spark

    def add(self, path: str) -> DataFrame:
        """Registers readable files under ``path``; a file of a known content keeps its row."""
        found = self.spark.read.format("binaryFile").load(path)
        name = F.substring_index("path", "/", -1)
        rows = found.select("path", name.alias("filename"), F.md5("content").alias("hash"), F.col("length").alias("size")).where(readers.accepted("filename"))
        rows = rows.select(
            F.concat(F.lit("file-"), "hash").alias("file_id"), "path", "filename", T.database_name(F.col("filename")).alias("database"),
            F.lit("uploaded").alias("status"), "size", F.current_timestamp().alias("upload_time"), F.lit(None).cast("timestamp").alias("process_time"), "hash",
        ).dropDuplicates(["file_id"])
        new = rows.join(self.store.read("files", rows).select("file_id"), "file_id", "left_anti").cache()
        try:
            if not new.isEmpty():
                self.store.commit(upsert={"files": new})
            return self.store.read("files", rows)
        finally:
            new.unpersist()

    def listed(self) -> DataFrame:
        """All files, the newest upload first."""
        return newest_first(self.store.read("files"))

    def delete(self, ids: list[str]) -> None:
        """Forgets files; what was extracted from them stays."""
        self.store.commit(delete={"files": self._ids(ids)})

    def embed(self, ids: list[str]) -> int:
        """Reads registered files and inserts them; their status tells how it went."""
        rows = self.store.read("files", self._ids(ids))
        paths = [r["path"] for r in rows.select("path").collect()]  # the caller's list bounds it
        if not paths:
            return 0
        try:
            n = self.engine.insert(readers.documents(self.spark, paths), "content")
        except Exception:
            self._mark(rows, "error")
            raise
        self._mark(rows, "embedded")
        return n

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "file_id string")

    def _mark(self, rows: DataFrame, status: str) -> None:
        done = rows.withColumns({"status": F.lit(status), "process_time": F.current_timestamp()}).cache()
        try:
            self.store.commit(upsert={"files": done})
        finally:
            done.unpersist()


def newest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("upload_time"), F.asc("file_id"))
