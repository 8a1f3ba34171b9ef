"""The node store: a JSON document of nodes, versioned snapshots of nodes, and JSON-lines records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.operators.nodes import NODE_SCHEMA, assert_new, delete, invalid_reason, upsert
from lexigrove.sources.snapshots import ConflictError, Snapshots

VERSION = "0.1.0"


def load_nodes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid nodes, rejected nodes with a reason) of ``{"version": ..., "nodes": [...]}``.

    ``path`` is one such document or a folder of them, read side by side. A
    later node of the same id wins, documents by the order of their names;
    absent optional fields get their defaults. A document without nodes, or one
    that is no JSON, is an error.
    """
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"version string, nodes array<struct<{_struct(NODE_SCHEMA)}>>").json(path)
    if not raw.filter("nodes is null").isEmpty() or raw.isEmpty():
        raise ValueError(f"{path} has no nodes")
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode("nodes").alias("pos", "node")).select(F.struct("file", "pos").alias("pos"), "node.*")
    rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).withColumn("source", F.coalesce("source", F.lit("manual")))
    for c in ("key_facts", "common_pitfalls", "children_ids", "related_concepts"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    told = rows.withColumn("reason", invalid_reason())
    fields = [c for c in told.columns if c not in ("reason", "pos")]
    valid = told.filter("reason is null").groupBy("id").agg(F.max_by(F.struct(*fields), "pos").alias("node")).select("node.*")
    return valid, told.filter("reason is not null")


def _struct(ddl: str) -> str:
    """Top-level commas and spaces of a DDL list, rewritten for a nested struct."""
    out, depth, parts = "", 0, []
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(out.strip())
            out = ""
        else:
            out += ch
    return ",".join(":".join(p.split(" ", 1)) for p in parts)


def save_nodes(nodes: DataFrame, path: str) -> None:
    """Nodes by id, one JSON object a line; the write is committed as a whole."""
    nodes.orderBy("id").write.mode("overwrite").json(path)


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines records; malformed lines are left out."""
    return spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)


class Store:
    """A node store in one place: changes are held back until :meth:`flush`, which commits them as one version.

    ``with Store(...) as s`` flushes at the end unless the block fails. A flush
    without changes writes nothing; otherwise the nodes, by id, are written to
    a folder of their own and become the next version in one atomic step, so
    readers see the old nodes or the new ones, at any time and after any
    crash. If another store has committed to the place since this one read it,
    the flush fails with :class:`ConflictError`; the changes are still held,
    and :meth:`rebase` carries them over to what is there now.
    """

    #: Versions that stay readable after a flush.
    KEEP = 2

    def __init__(self, spark: SparkSession, path: str, autosave: bool = False, create_if_missing: bool = True):
        self.spark, self.path, self.autosave = spark, path.rstrip("/"), autosave
        self.snapshots = Snapshots(spark, self.path)
        self._changes: list[Callable[[DataFrame], DataFrame]] = []
        self._read()
        if not self.version and not create_if_missing:
            raise FileNotFoundError(path)

    def _read(self) -> None:
        self.version = self.snapshots.version()
        entry = self.snapshots.entry(self.version)
        self.nodes = self.spark.read.schema(NODE_SCHEMA).json(entry["nodes"]) if entry else self.spark.createDataFrame([], NODE_SCHEMA)

    @property
    def dirty(self) -> bool:
        return bool(self._changes)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        if kind is None:
            self.flush()

    def __len__(self) -> int:
        return self.nodes.count()

    def __contains__(self, node_id: str) -> bool:
        return not self.nodes.filter(F.col("id") == node_id).isEmpty()

    def known(self, ids: DataFrame) -> DataFrame:
        """Those of the ids that the store has."""
        return ids.join(self.nodes.select("id"), "id", "left_semi")

    def put(self, nodes: DataFrame) -> None:
        """Add nodes, or replace those of the same id."""
        self._change(lambda held: upsert(held, nodes))

    def add(self, nodes: DataFrame) -> None:
        """Add nodes; an id that is there already is an error."""
        self._change(lambda held: assert_new(held, nodes))

    def remove(self, ids: DataFrame) -> None:
        self._change(lambda held: delete(held, ids))

    def _change(self, change: Callable[[DataFrame], DataFrame]) -> None:
        self.nodes = change(self.nodes)
        self._changes.append(change)
        if self.autosave:
            self.flush()

    def rebase(self) -> None:
        """Read the current version and make the held changes to it, in their order; an ``add`` of an id that is there by now fails."""
        self._read()
        for change in self._changes:
            self.nodes = change(self.nodes)

    def flush(self) -> bool:
        """Commit what has changed; whether anything was written."""
        if not self.dirty:
            return False
        staged = self.snapshots.stage("nodes")
        save_nodes(self.nodes, staged)
        try:
            self.snapshots.commit(self.version, {"nodes": staged})
        except ConflictError:
            self.snapshots.drop(staged)
            raise
        self._changes.clear()
        self._read()
        self.snapshots.expire(self.KEEP)
        return True


def predictions(tasks: DataFrame, root: str, key: str = "task_id") -> DataFrame:
    """(key, patch, status) of tasks against the patch files below a folder ``<key>=<id>``: missing, empty or present."""
    found = tasks.sparkSession.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract(F.input_file_name(), rf"{key}=([^/]+)", 1).alias("__id"), F.col("value").alias("patch"))
    joined = tasks.select(key).join(found, F.col(key).cast("string") == F.col("__id"), "left").drop("__id")
    status = F.when(F.col("patch").isNull(), "missing").when(F.trim(F.regexp_replace("patch", r"\s", "")) == "", "empty").otherwise("present")
    return joined.withColumn("status", status)
