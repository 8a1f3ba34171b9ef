"""Builds over changing files, and patches to them: files of several layouts from parts, numbered texts from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.plans.registry import Tables, query
from lexigrove.sources import patches as P
from lexigrove.sources.corpus import Corpus
from lexigrove.sources.scratch import scratch_path

# Layouts of files; {k} is the part's key, {s} its size. Beside each the definitions in it: kind, name, first and last line.
_LAYOUTS: tuple[tuple[str, tuple[tuple[str, str, int, int], ...]], ...] = (
    (
        '@route("/{k}")\nasync def fetch_{k}(url, *, retries={s}):\n    """Fetch one page."""\n    def once(u):\n        return get(u)\n    return await once(url)\n',
        (("function", "fetch_{k}", 2, 6), ("sub_function", "fetch_{k}.once", 4, 5)),
    ),
    (
        "import os\n\nclass Outer_{k}(Base):\n    limit = {s}\n\n    class Inner:\n        @property\n        def size(self):\n            return len(self.items)\n\n    @staticmethod\n    def make(x, y=2):\n        return Outer_{k}(x)\n",
        (("class", "Outer_{k}", 3, 13), ("class", "Outer_{k}.Inner", 6, 9), ("method", "Inner.size", 8, 9), ("method", "Outer_{k}.make", 12, 13)),
    ),
    (
        "import sys\nLIMIT = {s}\nif sys.platform:\n    def on_{k}():\n        pass\nelse:\n    def off_{k}():\n        class Local:\n            def run(self):\n                return LIMIT\n        return Local()\n\nprint(LIMIT)\n",
        (("function", "on_{k}", 4, 5), ("function", "off_{k}", 7, 11), ("class", "Local", 8, 10), ("method", "Local.run", 9, 10)),
    ),
    ("VALUE = {s}\nNAMES = ['a', 'b']\n", ()),
    ("def broken_{k}(:\n    return {s}\n", (("rejected", "", 0, 0),)),
)


def _filled(text: str) -> Column:
    return F.replace(F.replace(F.lit(text), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("size").cast("string"))


def _content() -> Column:
    """The file of a part, by its key's remainder; ``size`` is a column."""
    n = len(_LAYOUTS)
    out = F.when(F.col("p_partkey") % n == 0, _filled(_LAYOUTS[0][0]))
    for i, (text, _) in enumerate(_LAYOUTS[1:], 1):
        out = out.when(F.col("p_partkey") % n == i, _filled(text))
    return out


def _before(t: Tables) -> DataFrame:
    rows = t.part.filter("p_partkey % 30 <> 7").withColumn("size", F.col("p_size"))
    return rows.select(F.format_string("pkg/m%d.py", "p_partkey").alias("path"), _content().alias("content"))


def _after(t: Tables) -> DataFrame:
    """A twentieth of the files changed, a thirtieth new, a fiftieth gone."""
    rows = t.part.filter("p_partkey % 50 <> 11").withColumn("size", F.when(F.col("p_partkey") % 20 == 3, F.col("p_size") + 1000).otherwise(F.col("p_size")))
    return rows.select(F.format_string("pkg/m%d.py", "p_partkey").alias("path"), _content().alias("content"))


def _built_twice(t: Tables) -> Corpus:
    corpus = Corpus(t.spark, scratch_path(t.spark, "corpus"))
    corpus.build(_before(t))
    corpus.build(_after(t))
    return corpus


_DEFINED = " UNION ALL ".join(
    f"SELECT p_partkey, {pos} AS pos, '{kind}' AS kind, {'NULL' if kind == 'rejected' else repr(name).replace('{k}', chr(39) + ' || p_partkey || ' + chr(39))} AS qualified_name, {a or 'NULL'}::INTEGER AS start_line, {b or 'NULL'}::INTEGER AS end_line FROM part WHERE p_partkey % {len(_LAYOUTS)} = {i}"
    for i, (_, defs) in enumerate(_LAYOUTS)
    for pos, (kind, name, a, b) in enumerate(defs)
)
_BUILD = "CASE WHEN p_partkey % 30 = 7 OR p_partkey % 20 = 3 THEN 2 ELSE 1 END"


@query("a182_incremental_build", f"WITH defined AS ({_DEFINED}) SELECT 'pkg/m' || p_partkey || '.py' AS path, pos, kind, qualified_name, start_line, end_line, {_BUILD} AS build FROM defined WHERE p_partkey % 50 <> 11")
def a182(t: Tables) -> DataFrame:
    """The corpus after two builds; ``build`` tells when a file was parsed."""
    return _built_twice(t).rows().select("path", "pos", "kind", "qualified_name", "start_line", "end_line", "build")


@query(
    "a182_build_counts",
    """SELECT 1 AS version, count(*) AS files, count(*) AS added, 0 AS changed, 0 AS removed, 0 AS unchanged, count(*) AS parsed FROM part WHERE p_partkey % 30 <> 7
UNION ALL SELECT 2, count(*) FILTER (WHERE p_partkey % 50 <> 11), count(*) FILTER (WHERE p_partkey % 30 = 7 AND p_partkey % 50 <> 11),
count(*) FILTER (WHERE p_partkey % 20 = 3 AND p_partkey % 30 <> 7 AND p_partkey % 50 <> 11), count(*) FILTER (WHERE p_partkey % 30 <> 7 AND p_partkey % 50 = 11),
count(*) FILTER (WHERE p_partkey % 30 <> 7 AND p_partkey % 20 <> 3 AND p_partkey % 50 <> 11), count(*) FILTER (WHERE (p_partkey % 30 = 7 OR p_partkey % 20 = 3) AND p_partkey % 50 <> 11) FROM part""",
)
def a182_counts(t: Tables) -> DataFrame:
    """What each build met, and how many files entered the parser."""
    corpus = _built_twice(t)
    rows = [corpus.counts(v) for v in corpus.snapshots.versions()]
    return t.spark.createDataFrame([(c.version, c.files, c.added, c.changed, c.removed, c.unchanged, c.parsed) for c in rows], "version int, files long, added long, changed long, removed long, unchanged long, parsed long")


@query("a182_tombstones", "SELECT 'pkg/m' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 30 <> 7 AND p_partkey % 50 = 11")
def a182_tombstones(t: Tables) -> DataFrame:
    return _built_twice(t).tombstones().select("path")


# ------------------------------------------------------------------- patches

_LINES = "string_split(coalesce(text, ''), chr(10))"


def _numbered(t: Tables) -> DataFrame:
    """(doc_id, lines, n): each line of a document behind its number, so that no two are equal."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    return t.documents.select("doc_id", lines.alias("lines")).withColumn("n", F.size("lines"))


def _files(rows: DataFrame) -> DataFrame:
    """Every third document has two lines put before its first since its patch was made."""
    moved = F.when(F.col("doc_id") % 3 == 0, F.concat(F.array(F.lit("new"), F.lit("newer")), "lines")).otherwise(F.col("lines"))
    return rows.filter("doc_id % 11 <> 0").select(F.format_string("texts/%d.txt", "doc_id").alias("path"), F.concat(F.array_join(moved, "\n"), F.lit("\n")).alias("content"))


def _patches(rows: DataFrame) -> DataFrame:
    """Each patch replaces the line in the middle, with its neighbours as context, and says where: by the key's remainder rightly, with a changed context, a wrong count, twice, or not at all."""
    middle = F.floor((F.col("n") + 1) / 2).cast("int")
    rows = rows.withColumn("at", middle)
    lo, hi = F.greatest(F.col("at") - 1, F.lit(1)), F.least(F.col("at") + 1, F.col("n"))
    line = lambda i: F.element_at("lines", i)
    kind = F.col("doc_id") % 7
    context = lambda i, changed: F.concat(F.lit(" "), line(i), F.when(changed, F.lit(" (changed)")).otherwise(F.lit("")), F.lit("\n"))
    body = F.concat(
        F.when(lo < F.col("at"), context(lo, kind == 1)).otherwise(F.lit("")), F.lit("-"), line(F.col("at")), F.lit("\n+"), F.lit("put in its place\n"),
        F.when(hi > F.col("at"), context(hi, kind == 1)).otherwise(F.lit("")),
    )
    size = (hi - lo + 1).cast("string")
    head = lambda declared: F.concat(F.lit("@@ -"), lo.cast("string"), F.lit(","), declared, F.lit(" +"), lo.cast("string"), F.lit(","), size, F.lit(" @@\n"))
    name = F.format_string("texts/%d.txt", "doc_id")
    top = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"))
    text = (
        F.when(kind == 2, F.concat(top, head((hi - lo + 2).cast("string")), body)).when(kind == 3, F.concat(top, head(size), body, head(size), body))
        .when(kind == 4, F.lit(" \n")).otherwise(F.concat(top, head(size), body))
    )
    return rows.select("doc_id", text.alias("patch"))


@query(
    "a132_patch_check",
    f"""WITH sized AS (SELECT doc_id, len({_LINES}) AS n FROM documents), told AS (
  SELECT doc_id, n, (n + 1) // 2 AS mid, doc_id % 7 AS kind, doc_id % 3 = 0 AS moved FROM sized
), stuck AS (
  -- Moved down, a hunk that begins with line 1 no longer lies at the beginning; one without context after its change still lies at the end.
  SELECT *, moved AND mid <= 2 AS off FROM told
)
SELECT doc_id, reason IS NULL AS applies, reason, n_hunks::BIGINT AS n_hunks, CASE WHEN reason IN ('empty', 'malformed', 'missing_file', 'conflict') THEN 0 WHEN moved AND NOT off THEN 1 ELSE 0 END::BIGINT AS n_shifted FROM (
  SELECT *, CASE kind WHEN 4 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS n_hunks,
    CASE WHEN kind = 4 THEN 'empty' WHEN kind = 2 THEN 'malformed' WHEN doc_id % 11 = 0 THEN 'missing_file' WHEN off OR kind = 1 AND n > 1 THEN 'conflict' WHEN kind = 3 THEN 'overlap' END AS reason FROM stuck)""",
)
def a132(t: Tables) -> DataFrame:
    """Patches made against documents, checked against files that have changed since."""
    rows = _numbered(t)
    return P.check_patches(_patches(rows), _files(rows), "doc_id")


@query(
    "a132_hunk_places",
    f"""WITH told AS (SELECT doc_id, len({_LINES}) AS n, (len({_LINES}) + 1) // 2 AS mid, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS down FROM documents WHERE doc_id % 7 IN (0, 5, 6) AND doc_id % 11 <> 0)
SELECT doc_id, 'texts/' || doc_id || '.txt' AS path, CASE WHEN down > 0 AND mid <= 2 THEN 'conflict' WHEN down > 0 THEN 'shifted' ELSE 'exact' END AS status,
CASE WHEN down = 0 OR mid > 2 THEN greatest(mid - 1, 1) + down END::BIGINT AS line, CASE WHEN down = 0 OR mid > 2 THEN down END::BIGINT AS "offset" FROM told""",
)
def a132_places(t: Tables) -> DataFrame:
    rows = _numbered(t)
    wanted = rows.filter("doc_id % 7 in (0, 5, 6) and doc_id % 11 <> 0")
    return P.check_hunks(_patches(wanted), _files(rows), "doc_id").select("doc_id", "path", "status", "line", "offset")
