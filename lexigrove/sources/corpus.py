"""An incrementally built corpus of definitions.

A version of the corpus is a manifest, one row a file with the digest of its
content and the build that parsed it, and the rows of those builds. A build
compares the files' digests with the manifest it starts from, parses only what
is new or changed, and commits a new manifest. Removed files need no rewrite:
no manifest row, no rows of theirs (they are kept as tombstones for one
version). Once less than ``COMPACT`` of the stored rows are live, a build
rewrites the live ones into one folder; file by file the rows and the build
that they are from stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexigrove.sources.snapshots import Snapshots
from lexigrove.sources.source_code import extract

MANIFEST = "path string, digest string, n_bytes long, build int, n_rows long"
#: Part of the stored rows that must be live.
COMPACT = 0.5


@dataclass(frozen=True)
class Counts:
    """What a build met and did; ``parsed`` is counted where files enter the parser."""

    version: int
    files: int
    added: int
    changed: int
    removed: int
    unchanged: int
    parsed: int
    compacted: bool


class RepeatedPath(ValueError):
    """A path occurs twice among the files."""


class Corpus:
    """Definitions of a changing set of files: (path, content) rows in, :func:`extract`'s rows out.

    ``parse`` may be any function from (path, content) to rows with a
    ``path``. Null contents count as empty files.
    """

    def __init__(self, spark: SparkSession, root: str, parse: Callable[[DataFrame], DataFrame] = extract):
        self.spark, self.parse, self.snapshots = spark, parse, Snapshots(spark, root)

    # ------------------------------------------------------------------- reading

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, digest, n_bytes, build, n_rows) of a version, the current one if none is named."""
        entry = self._entry(version)
        return self.spark.read.schema(MANIFEST).parquet(entry["manifest"]) if entry else self.spark.createDataFrame([], MANIFEST)

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version's files, each with the ``build`` that parsed it."""
        entry = self._entry(version)
        if not entry:
            raise LookupError("nothing has been built")
        live = self.manifest(version).filter("n_rows > 0").select("path", "build")
        stored = self.spark.read.parquet(*entry["rows"])
        return stored.join(live, ["path", "build"], "left_semi")

    def tombstones(self, version: int | None = None) -> DataFrame:
        """(path, digest) of the files that a version's build found removed."""
        entry = self._entry(version)
        return self.spark.read.schema("path string, digest string").parquet(entry["tombstones"]) if entry else self.spark.createDataFrame([], "path string, digest string")

    def counts(self, version: int | None = None) -> Counts:
        return Counts(**self._entry(version)["counts"])

    def _entry(self, version: int | None) -> dict:
        return self.snapshots.entry(self.snapshots.version() if version is None else version)

    # ------------------------------------------------------------------ building

    def changes(self, files: DataFrame, version: int | None = None) -> DataFrame:
        """(path, digest, n_bytes, change, old_digest, build, n_rows): every file of either side as added, changed, removed or unchanged."""
        content = F.coalesce("content", F.lit(""))
        now = files.select("path", F.sha2(content.cast("binary"), 256).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"))
        old = self.manifest(version).select("path", F.col("digest").alias("old_digest"), "build", "n_rows", F.col("n_bytes").alias("old_bytes"))
        change = (
            F.when(F.col("old_digest").isNull(), "added").when(F.col("digest").isNull(), "removed")
            .when(F.col("digest") != F.col("old_digest"), "changed").otherwise("unchanged")
        )
        return now.join(old, "path", "full").select("path", "digest", "n_bytes", change.alias("change"), "old_digest", "build", "n_rows")

    def build(self, files: DataFrame) -> Counts:
        """Bring the corpus to ``files`` (path, content) and commit; only new and changed ones are parsed.

        A build that finds nothing to do commits nothing. If another build
        commits first, this one fails and the corpus is the other's.
        """
        s, read = self.snapshots, self.snapshots.version()
        entry, version = s.entry(read), read + 1
        at = {name: s.stage(name) for name in ("changes", "rows", "manifest", "tombstones")}
        self.changes(files, read).write.parquet(at["changes"])
        changes = self.spark.read.parquet(at["changes"])
        met = {r["change"]: r for r in changes.groupBy("change").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths")).collect()}
        if any(r["n"] != r["paths"] for r in met.values()):
            self.snapshots.drop(at["changes"])
            raise RepeatedPath("a path occurs twice")
        n = {k: met[k]["n"] if k in met else 0 for k in ("added", "changed", "removed", "unchanged")}
        if entry and not n["added"] + n["changed"] + n["removed"]:
            self.snapshots.drop(at["changes"])
            return Counts(read, n["unchanged"], 0, 0, 0, n["unchanged"], 0, False)
        todo = changes.filter("change in ('added', 'changed')").select("path")
        seen = Observation()
        fresh = files.select("path", F.coalesce("content", F.lit("")).alias("content")).join(todo, "path", "left_semi").observe(seen, F.count("*").alias("n"))
        self.parse(fresh).withColumn("build", F.lit(version)).write.parquet(at["rows"])
        parsed = seen.get["n"]
        made = self.spark.read.parquet(at["rows"]).groupBy("path").agg(F.count("*").alias("made"))
        after = changes.filter("change <> 'removed'").join(made, "path", "left")
        is_new = F.col("change") != "unchanged"
        after.select(
            "path", "digest", "n_bytes", F.when(is_new, version).otherwise(F.col("build")).alias("build"),
            F.when(is_new, F.coalesce("made", F.lit(0))).otherwise(F.col("n_rows")).cast("long").alias("n_rows"),
        ).write.parquet(at["manifest"])
        changes.filter("change = 'removed'").select("path", F.col("old_digest").alias("digest")).write.parquet(at["tombstones"])
        rows, compacted = [*entry.get("rows", []), at["rows"]], False
        stored = self.spark.read.parquet(*rows)
        live = self.spark.read.schema(MANIFEST).parquet(at["manifest"])
        if len(rows) > 1 and live.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0] < COMPACT * stored.count():
            whole = s.stage("rows")
            stored.join(live.filter("n_rows > 0").select("path", "build"), ["path", "build"], "left_semi").write.parquet(whole)
            rows, compacted = [whole], True
        counts = Counts(version, n["added"] + n["changed"] + n["unchanged"], n["added"], n["changed"], n["removed"], n["unchanged"], parsed, compacted)
        s.commit(read, {"manifest": at["manifest"], "rows": rows, "tombstones": at["tombstones"], "counts": asdict(counts)})
        self.snapshots.drop(at["changes"])
        return counts
