"""One directory a database, Parquet tables in it; all-or-nothing commits (ids S9-S13, K2, K4, X18-X24, I9-I12).

A table is a set of parts.  Tables that only grow get a new part for each addition;
tables whose rows change are dealt into ``BUCKETS`` parts by key, and a change rewrites
the parts it touches.  A commit writes its parts to new folders and then replaces the
manifest in one rename, so readers see all of it or none.  Paths go through the Hadoop
file system.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import EDGE_SEP, edge_key
from loomgraph.operators.ingest import insert_if_absent
from loomgraph.schema import KEYS, TABLES

BUCKETS = 64


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def manifest(self) -> dict[str, dict[str, str]]:
        """Table to part to folder."""
        at = self._path(f"{self.path}/manifest.json")
        if not self._fs.exists(at):
            return {}
        stream = self._fs.open(at)
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _open(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        at = [f"{self.path}/{f}" for f in sorted(folders)]
        # parts written before a field was added read it as null
        return self.spark.read.schema(TABLES[table]).option("recursiveFileLookup", "true").parquet(*at)

    def read(self, table: str, keys: DataFrame | None = None) -> DataFrame:
        """A table (an empty one of its schema if it was never written); with ``keys`` only the
        rows of those keys, from the parts that may have them."""
        parts = self.manifest().get(table, {})
        if keys is None:
            return self._open(table, list(parts.values()))
        key = KEYS[table]
        asked = keys.select(key).distinct()
        some = {str(r["b"]) for r in asked.select(self._bucket(key).alias("b")).distinct().collect()}
        return self._open(table, [f for b, f in parts.items() if b in some]).join(asked, key, "left_semi")

    @staticmethod
    def _bucket(key: str):
        return F.pmod(F.xxhash64(key), F.lit(BUCKETS))

    def _dealt(self, table: str, df: DataFrame) -> dict[str, str]:
        """Writes a keyed table's rows; part to folder of the parts that have any."""
        name = f"{table}-{uuid.uuid4().hex}"
        rows = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(TABLES[table][c].dataType).alias(c) for c in TABLES[table].names])
        rows.withColumn("__bucket", self._bucket(KEYS[table])).write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        found = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/{name}")) if x.isDirectory()]
        return {f.split("=")[1]: f"{name}/{f}" for f in found if f.startswith("__bucket=")}

    def _grown(self, table: str, df: DataFrame) -> dict[str, str]:
        name = f"{table}-{uuid.uuid4().hex}"
        df.select(*TABLES[table].names).write.parquet(f"{self.path}/{name}")
        return {name: name}

    def _changed(self, table: str, parts: dict[str, str], keys: DataFrame, rows: DataFrame | None) -> dict[str, str]:
        """The parts after rows of ``keys`` went and ``rows`` came."""
        key = KEYS[table]
        asked = keys.select(key).distinct()
        touched = {str(r["b"]) for r in asked.select(self._bucket(key).alias("b")).distinct().collect()}
        left = self._open(table, [f for b, f in parts.items() if b in touched]).join(asked, key, "left_anti")
        if rows is not None:
            left = left.unionByName(rows.dropDuplicates([key]).select(*[c for c in TABLES[table].names if c in rows.columns]), allowMissingColumns=True)
        return {b: f for b, f in parts.items() if b not in touched} | (self._dealt(table, left) if touched else {})

    def commit(
        self,
        replace: dict[str, DataFrame] | None = None,
        *,
        append: dict[str, DataFrame] | None = None,
        upsert: dict[str, DataFrame] | None = None,
        delete: dict[str, DataFrame] | None = None,
    ) -> None:
        """Changes tables together; on any error nothing changes.  ``delete`` names rows by key."""
        new = {t: dict(parts) for t, parts in self.manifest().items()}
        for t, df in (replace or {}).items():
            new[t] = self._dealt(t, df) if t in KEYS else self._grown(t, df)
        for t, df in (append or {}).items():
            new[t] = new.get(t, {}) | self._grown(t, df)
        for t, df in (upsert or {}).items():
            new[t] = self._changed(t, new.get(t, {}), df, df)
        for t, df in (delete or {}).items():
            new[t] = self._changed(t, new.get(t, {}), df, None)
        self._publish(new)

    def _publish(self, new: dict[str, dict[str, str]]) -> None:
        temp, final = self._path(f"{self.path}/manifest-{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest.json")
        out = self._fs.create(temp)
        try:
            out.write(bytearray(json.dumps(new).encode()))
        finally:
            out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(temp), context.makeQualified(final), options)

    def drop(self, *tables: str) -> None:
        """Empties tables, or all of them."""
        self._publish({t: p for t, p in self.manifest().items() if tables and t not in tables})

    def compact(self, table: str) -> None:
        """One part for a table that grew by many."""
        self.commit({table: self.read(table)})

    def counts(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in TABLES}

    def vacuum(self) -> None:
        """Deletes table folders that the manifest no longer names."""
        live = {f.split("/")[0] for parts in self.manifest().values() for f in parts.values()}
        for s in self._fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if s.isDirectory() and name not in live:
                self._fs.delete(s.getPath(), True)

    def get(self, table: str, key: str, ids: list[str], fields: list[str] | None = None) -> DataFrame:
        """Rows by id in the asked order; null fields where an id is missing."""
        asked = self.spark.createDataFrame(list(enumerate(ids)), "pos int, id string").withColumnRenamed("id", key)
        rows = self.read(table)
        return asked.join(rows.select(key, *[f for f in (fields or rows.columns) if f != key]), key, "left").orderBy("pos").drop("pos")

    def add(self, table: str, key: str, rows: DataFrame) -> DataFrame:
        """Insert-if-absent; returns the new table, uncommitted."""
        return insert_if_absent(self.read(table), rows, key)

    # --------------------------------------------------------- one by one
    def _names(self, table: str, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in names], f"{KEYS[table]} string")

    def one(self, table: str, name: str) -> dict | None:
        """A row of a keyed table, or None."""
        row = self.read(table, self._names(table, [name])).first()
        return row.asDict() if row else None

    def vertex(self, name: str) -> dict | None:
        return self.one("vertices", name)

    def edge(self, members: list[str]) -> dict | None:
        return self.one("edges", EDGE_SEP.join(sorted(set(members))))

    def _row(self, table: str, fields: dict) -> DataFrame:
        schema = TABLES[table]
        wrong = set(fields) - set(schema.names)
        if wrong:
            raise ValueError(f"{table} has no {sorted(wrong)}")
        listed = {c: [v] if isinstance(v, str) and schema[c].dataType.simpleString() == "array<string>" else v for c, v in fields.items()}
        return self.spark.createDataFrame([tuple(listed.get(c) for c in schema.names)], schema)

    def create_vertex(self, name: str, **fields) -> DataFrame:
        """A new vertex; an existing one is an error.  Returns its row."""
        if self.vertex(name) is not None:
            raise ValueError(f"vertex {name!r} exists")
        row = self._row("vertices", {"entity_type": "UNKNOWN", "description": [], "additional_properties": [], "source_id": []} | fields | {"entity_name": name})
        self.commit(upsert={"vertices": row})
        return row

    def create_edge(self, members: list[str], **fields) -> DataFrame:
        """A new hyperedge of known vertices; an existing one or an unknown member is an error."""
        names = sorted(set(members))
        if len(names) < 2:
            raise ValueError("an edge has two members or more")
        if self.edge(names) is not None:
            raise ValueError(f"edge {names} exists")
        known = {r["entity_name"] for r in self.read("vertices", self._names("vertices", names)).select("entity_name").collect()}
        if set(names) - known:
            raise ValueError(f"unknown members {sorted(set(names) - known)}")
        full = {"description": [], "keywords": [], "source_id": [], "weight": 1.0} | fields
        row = self._row("edges", full | {"edge_key": EDGE_SEP.join(names), "entity_set": names, "arity": len(names)})
        self.commit(upsert={"edges": row})
        return row

    def _update(self, table: str, name: str, fields: dict) -> DataFrame:
        old = self.one(table, name)
        if old is None:
            raise KeyError(name)
        # empty values keep what was there
        row = self._row(table, old | {k: v for k, v in fields.items() if v not in (None, "", [])})
        self.commit(upsert={table: row})
        return row

    def update_vertex(self, name: str, **fields) -> DataFrame:
        """New non-empty fields of an existing vertex; its edges stay."""
        return self._update("vertices", name, fields)

    def update_edge(self, members: list[str], **fields) -> DataFrame:
        return self._update("edges", EDGE_SEP.join(sorted(set(members))), fields)

    def delete_edge(self, members: list[str]) -> None:
        """Removes a hyperedge and its vector; KeyError if it is not there."""
        key = EDGE_SEP.join(sorted(set(members)))
        if self.one("edges", key) is None:
            raise KeyError(key)
        gone = self._names("edges", [key])
        self.commit(delete={"edges": gone, "vec_edges": gone})

    def delete_vertices(self, names: list[str]) -> None:
        """Removes vertices with their edges' parts and all their vectors; only touched parts are
        written again."""
        from loomgraph.operators.graph import remove_vertices

        edges = self.read("edges")
        touched = edges.where(F.arrays_overlap("entity_set", F.array(*[F.lit(n) for n in names])))
        cut = touched.select(F.array_except("entity_set", F.array(*[F.lit(n) for n in names])).alias("m")).where(F.size("m") >= 2)
        near = touched.select("edge_key").unionByName(cut.select(edge_key(F.col("m")).alias("edge_key"))).distinct().cache()
        try:
            _, after = remove_vertices(self.read("vertices"), self.read("edges", near), names)
            after = after.cache()
            gone = near.join(after, "edge_key", "left_anti")
            self.commit(
                upsert={"edges": after},
                delete={"vertices": self._names("vertices", names), "vec_entities": self._names("vec_entities", names), "edges": gone, "vec_edges": gone},
            )
            after.unpersist()
        finally:
            near.unpersist()


def databases(spark: SparkSession, root: str) -> list[str]:
    """Sub-folders of the root that hold a database."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path(root)) if s.isDirectory()) if fs.exists(path(root)) else []
