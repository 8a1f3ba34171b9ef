"""Source-code queries: every part stands for a file, every order for an answer with edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.functions import text as T
from lexigrove.operators import similarity
from lexigrove.operators.joins import dealt
from lexigrove.plans.registry import Tables, query
from lexigrove.sources import source_code as S
from lexigrove.sources.scratch import cut, scratch_path

# One file a part: a class with a method, and a function. Every fiftieth does not parse.
_LINES = (
    "class C{k}:", "    def load_{k}(self, a, b=1):", '        """Load {n}.', "", "        Of size {s}.", '        """', "        value = helper_{m}(a)", "        return self.store(value, b)", "", "",
    "def helper_{k}(x):", "    return x", "",
)
_BROKEN = "def broken(:\n"


def _filled(line: str) -> F.Column:
    parts = {"{k}": F.col("p_partkey").cast("string"), "{n}": F.col("p_name"), "{s}": F.col("p_size").cast("string"), "{m}": (F.col("p_partkey") % 7).cast("string")}
    out, at = [], 0
    while at < len(line):
        hit = min(((line.find(p, at), p) for p in parts if line.find(p, at) >= 0), default=None)
        if hit is None:
            out.append(F.lit(line[at:]))
            break
        out += [F.lit(line[at : hit[0]]), parts[hit[1]]]
        at = hit[0] + len(hit[1])
    return F.concat(*out) if out else F.lit("")


def _sql(line: str) -> str:
    quoted = line.replace("'", "''")
    for k, v in (("{k}", "p_partkey"), ("{n}", "p_name"), ("{s}", "p_size"), ("{m}", "p_partkey % 7")):
        quoted = quoted.replace(k, f"' || ({v}) || '")
    return f"'{quoted}'"


def _parts(t: Tables) -> DataFrame:
    """Parts as files are made of them: a row is short, and what is read from its file is work."""
    return dealt(t.part.select("p_partkey", "p_name", "p_size"), "p_partkey")


def files(t: Tables) -> DataFrame:
    """(path, content) of one file a part."""
    whole = F.concat_ws("\n", *map(_filled, _LINES))
    return _parts(t).select(F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.when(F.col("p_partkey") % 50 == 0, F.lit(_BROKEN)).otherwise(whole).alias("content"))


_BODY = lambda a, b: " || chr(10) || ".join(map(_sql, _LINES[a:b]))
_DEFS = f"""files AS (SELECT *, 'src/m' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 50 <> 0),
defs AS (
  SELECT path, 0 AS pos, 'class' AS kind, 'C' || p_partkey AS qualified_name, 1 AS start_line, 8 AS end_line, {_sql(_LINES[0])} AS signature, '' AS params, NULL::VARCHAR AS docstring, {_BODY(0, 8)} AS source,
    'helper_' || (p_partkey % 7) || ',store' AS calls, p_partkey, p_size, p_name FROM files
  UNION ALL SELECT path, 1, 'method', 'C' || p_partkey || '.load_' || p_partkey, 2, 8, {_sql(_LINES[1].strip())}, 'self,a,b', 'Load ' || p_name || '.' || chr(10) || chr(10) || 'Of size ' || p_size || '.', {_BODY(1, 8)},
    'helper_' || (p_partkey % 7) || ',store', p_partkey, p_size, p_name FROM files
  UNION ALL SELECT path, 2, 'function', 'helper_' || p_partkey, 11, 12, {_sql(_LINES[10])}, 'x', NULL, {_BODY(10, 12)}, '', p_partkey, p_size, p_name FROM files)"""


@query("a16_scan_files", "SELECT n_nationkey::INT AS k, length('name = ' || n_name)::INT AS n FROM nation WHERE n_nationkey NOT IN (3, 13)")
def a16(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "files")
    t.nation.select("n_nationkey", F.concat(F.lit("name = "), "n_name").alias("value")).write.partitionBy("n_nationkey").text(root)
    found = S.scan_files(t.spark, root, "*.txt", ("n_nationkey=3/", "n_nationkey=*13"))
    return found.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("k"), F.length(F.rtrim(F.regexp_replace("content", "\n", ""))).alias("n"))


@query("a110_definitions", f"WITH {_DEFS} SELECT path, pos, kind, qualified_name, start_line, end_line, signature, params, source FROM defs UNION ALL SELECT 'src/m' || p_partkey || '.py', 0, 'rejected', NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 50 = 0")
def a110(t: Tables) -> DataFrame:
    return S.extract(files(t)).select("path", "pos", "kind", "qualified_name", "start_line", "end_line", "signature", F.array_join("params", ",").alias("params"), "source")


@query("a111_calls", f"WITH {_DEFS} SELECT path, qualified_name, calls FROM defs")
def a111(t: Tables) -> DataFrame:
    return S.extract(files(t)).filter("kind <> 'rejected'").select("path", "qualified_name", F.array_join("calls", ",").alias("calls"))


@query("a112_docstrings", f"WITH {_DEFS} SELECT path, qualified_name, docstring FROM defs WHERE docstring IS NOT NULL")
def a112(t: Tables) -> DataFrame:
    return S.extract(files(t)).filter("docstring is not null").select("path", "qualified_name", "docstring")


@query("a113_body_text", f"WITH {_DEFS} SELECT path, qualified_name, length(source)::INT AS n_chars, (length(source) - length(ltrim(source)))::INT AS indent FROM defs WHERE kind <> 'class'")
def a113(t: Tables) -> DataFrame:
    rows = S.extract(files(t)).filter("kind in ('method', 'function')")
    return rows.select("path", "qualified_name", F.length("source").alias("n_chars"), (F.length("source") - F.length(F.ltrim("source"))).alias("indent"))


_ID = "lower(translate('lib/' || path, '/.', '__'))"


@query("a114_file_nodes", f"WITH {_DEFS} SELECT {_ID} || '__' || lower(qualified_name) AS id, 'lib/' || path AS file, kind AS type FROM defs WHERE kind <> 'class'")
def a114(t: Tables) -> DataFrame:
    return S.assembled(S.extract(files(t)), include_classes=False, path_prefix="lib/").select("id", "file", "type")


@query(
    "a115_assembled",
    f"""WITH {_DEFS} SELECT {_ID} || '__' || lower(qualified_name) AS id, substr(kind || ': ' || qualified_name || '(' || replace(params, ',', ', ') || ')', 1, 200) AS title,
coalesce(docstring, kind || ' ' || qualified_name || ' in lib/' || path) AS definition,
concat_ws(' | ', 'Signature: ' || signature, 'Location: lib/' || path || ':' || start_line || '-' || end_line, 'Type: ' || kind, CASE WHEN docstring IS NOT NULL THEN 'Description: Load ' || p_name || '.' END) AS key_facts,
CASE WHEN kind = 'method' THEN {_ID} || '__c' || p_partkey ELSE {_ID} END AS parent_id FROM defs""",
)
def a115(t: Tables) -> DataFrame:
    return S.assembled(S.extract(files(t)), path_prefix="lib/").select("id", "title", "definition", F.array_join("key_facts", " | ").alias("key_facts"), "parent_id")


@query(
    "a116_sub_chunk",
    "SELECT doc_id, CASE WHEN len(l) > 20 THEN array_to_string(l[1:8], chr(10)) || chr(10) || chr(10) || '# ... (' || len(l) || ' total lines, middle truncated) ...' || chr(10) || chr(10) || array_to_string(l[-4:], chr(10)) ELSE text END AS chunk FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)",
)
def a116(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", S.sub_chunk(F.col("text"), 8, 4, 20).alias("chunk"))


@query("a117_counters", f"WITH {_DEFS} SELECT (SELECT count(*) FROM part) AS n_files, (SELECT count(*) FROM files) AS n_parsed, (SELECT count(*) FROM part WHERE p_partkey % 50 = 0) AS n_errors, count(*) FILTER (WHERE kind <> 'class') AS n_built, count(*) FILTER (WHERE kind = 'class') AS n_skipped FROM defs")
def a117(t: Tables) -> DataFrame:
    found = S.extract(files(t))
    return S.counters(files(t), found, S.assembled(found, include_classes=False))


_DOC = "'Part ' || p_name || chr(10) || chr(10) || 'Parameters' || chr(10) || '----------' || chr(10) || 'size : int' || chr(10) || chr(10) || 'Examples' || chr(10) || '--------' || chr(10) || '>>> f(' || p_size || ')' || chr(10) || p_brand || chr(10) || '>>> g()'"


def _docs(t: Tables) -> DataFrame:
    c = lambda x: F.lit(x)
    return t.part.select("p_partkey", F.concat(c("Part "), "p_name", c("\n\nParameters\n----------\nsize : int\n\nExamples\n--------\n>>> f("), F.col("p_size").cast("string"), c(")\n"), "p_brand", c("\n>>> g()")).alias("doc"))


@query("a67_doc_sections", "SELECT p_partkey, 0 AS pos, 'summary' AS section, 'Part ' || p_name AS body FROM part UNION ALL SELECT p_partkey, 1, 'parameters', 'size : int' FROM part UNION ALL SELECT p_partkey, 2, 'examples', '>>> f(' || p_size || ')' || chr(10) || p_brand || chr(10) || '>>> g()' FROM part")
def a67(t: Tables) -> DataFrame:
    return S.docstring_parts(_docs(t), "p_partkey", "doc")


@query("a68_doctests", "SELECT p_partkey, 0 AS pos, 'f(' || p_size || ')' AS code, p_brand AS output FROM part UNION ALL SELECT p_partkey, 1, 'g()', '' FROM part")
def a68(t: Tables) -> DataFrame:
    return S.docstring_examples(_docs(t), "p_partkey", "doc")


@query("a118_api_nodes", "SELECT 'pkg_df_' || lower(replace(p_brand, '#', '_')) || '_' || p_partkey AS id, 'pkg.DataFrame.' || replace(p_brand, '#', '_') || '.' || p_partkey AS qualified, 'Part ' || p_name AS definition, '>>> f(' || p_size || ')' || chr(10) || p_brand AS example FROM part")
def a118(t: Tables) -> DataFrame:
    """Nodes of API names from their docstrings: id, qualified name, summary, first example."""
    docs = t.part.select("p_partkey", F.concat(F.lit("DataFrame."), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("."), F.col("p_partkey").cast("string")).alias("name"))
    qualified = T.api_name(F.col("name"), "pkg", {"p": "pkg"})
    summary = S.docstring_parts(_docs(t), "p_partkey", "doc").filter("section = 'summary'").select("p_partkey", F.col("body").alias("definition"))
    example = S.docstring_examples(_docs(t), "p_partkey", "doc").filter("pos = 0").select("p_partkey", F.concat(F.lit(">>> "), "code", F.lit("\n"), "output").alias("example"))
    return docs.join(summary, "p_partkey").join(example, "p_partkey").select(T.api_id(qualified, "pkg").alias("id"), qualified.alias("qualified"), "definition", "example")


_API = "CASE p_partkey % 5 WHEN 0 THEN 'p.scan_' || p_partkey WHEN 1 THEN 'DataFrame.pivot_' || p_partkey WHEN 2 THEN 'Expr.str.has_' || p_partkey WHEN 3 THEN 'pkg.Series.Sum_' || p_partkey ELSE 'other.f_' || p_partkey END"
_QUALIFIED = "CASE p_partkey % 5 WHEN 0 THEN 'pkg.scan_' || p_partkey WHEN 1 THEN 'pkg.DataFrame.pivot_' || p_partkey WHEN 2 THEN 'pkg.Expr.str.has_' || p_partkey WHEN 3 THEN 'pkg.Series.Sum_' || p_partkey ELSE 'other.f_' || p_partkey END"


@query("a31_api_names", f"SELECT p_partkey, {_QUALIFIED} AS qualified FROM part")
def a31(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.expr(_API).alias("name")).select("p_partkey", T.api_name(F.col("name"), "pkg", {"p": "pkg"}).alias("qualified"))


@query("a30_api_ids", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'pkg_scan_' WHEN 1 THEN 'pkg_df_pivot_' WHEN 2 THEN 'pkg_str_has_' WHEN 3 THEN 'pkg_series_sum_' ELSE 'pkg_other_f_' END || p_partkey AS id FROM part")
def a30(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.api_id(F.expr(_QUALIFIED), "pkg").alias("id"))


# ------------------------------------------------------------- answers of models

_ANSWER = "CASE p_partkey % 5 WHEN 0 THEN '{\"a\": ' || p_size || '}' WHEN 1 THEN '```json' || chr(10) || '{\"a\": {\"b\": ' || p_size || '}}' || chr(10) || '```' WHEN 2 THEN 'So: {\"a\": {\"b\": ' || p_size || '}} and {more}' WHEN 3 THEN 'broken {\"a\": ' || p_size ELSE 'none' END"


@query("a73_balanced_json", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '{\"a\": ' || p_size || '}' WHEN 1 THEN '{\"a\": {\"b\": ' || p_size || '}}' WHEN 2 THEN '{\"a\": {\"b\": ' || p_size || '}}' END AS json FROM part")
def a73(t: Tables) -> DataFrame:
    answer = F.expr(_ANSWER.replace("chr(10)", "'\\n'"))
    return t.part.select("p_partkey", T.balanced_json(answer).alias("json"))


@query("a77_inject_fields", f"WITH {_DEFS} SELECT path, pos, qualified_name AS qualified, regexp_extract(qualified_name, '[^.]+$') AS name, start_line, end_line, kind AS type FROM defs")
def a77(t: Tables) -> DataFrame:
    rows = S.extract(files(t)).filter("kind <> 'rejected'")
    place = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    inject = F.concat(F.lit("## "), "kind", F.lit(": "), "qualified_name", F.lit("(x)\n\n- Location: "), place, F.lit("\n- Type: "), "kind")
    return rows.select("path", "pos", T.inject_fields(inject).alias("f")).select("path", "pos", "f.qualified", "f.name", "f.start_line", "f.end_line", "f.type")


@query("a78_called_names", f"WITH {_DEFS} SELECT path, 'C' || p_partkey || '.load_' || p_partkey AS qualified_name, 'load_' || p_partkey || ',helper_' || (p_partkey % 7) || ',store' AS names FROM defs WHERE kind = 'method'")
def a78(t: Tables) -> DataFrame:
    rows = S.extract(files(t)).filter("kind = 'method'")
    return rows.select("path", "qualified_name", F.array_join(T.called_names(F.col("source")), ",").alias("names"))


_PATCH = "'diff --git a/f' || p_partkey || '.py b/f' || p_partkey || '.py' || chr(10) || '{index}--- a/f' || p_partkey || '.py' || chr(10) || '+++ b/f' || p_partkey || '.py' || chr(10) || '@@ -1,2 +1,2 @@ def g_' || p_size || '(x):' || chr(10) || '-a' || chr(10) || '+b'"


def _patch(index: str = "") -> F.Column:
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit(f"\n{index}--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1,2 +1,2 @@ def g_"), F.col("p_size").cast("string"), F.lit("(x):\n-a\n+b"))


@query("a79_repaired_diff", f"SELECT p_partkey, {_PATCH.replace('{index}', '')} AS diff FROM part")
def a79(t: Tables) -> DataFrame:
    """Diffs spoilt in four ways, put right again."""
    spoilt = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Here:\n```diff\n"), _patch("index someindex..anotherindex\n"), F.lit("\n```\nDone.")))
    spoilt = spoilt.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("I think that\n"), F.replace(_patch("index abcxyz..0123456 100644\n"), F.lit("diff --git"), F.lit("diff--git"))))
    spoilt = spoilt.when(F.col("p_partkey") % 4 == 2, F.concat(_patch(), F.lit("\nThis change helps.\nIt does."))).otherwise(F.concat(_patch(), F.lit("\n")))
    return _parts(t).select("p_partkey", T.repaired_diff(spoilt).alias("diff"))


@query("a178_longest_diff", f"SELECT p_partkey, {_PATCH.replace('{index}', '')} AS diff FROM part")
def a178(t: Tables) -> DataFrame:
    answer = F.concat(F.lit("diff --git a/x b/x\n```\nor\n```\n"), _patch(), F.lit("\n```\nend"))
    return t.part.select("p_partkey", F.rtrim(F.regexp_replace(T.longest_diff(answer), "\n$", "")).alias("diff"))


@query("a80_modified_functions", "SELECT p_partkey, 'g_' || p_size || ',h' AS names FROM part")
def a80(t: Tables) -> DataFrame:
    pairs = F.concat(F.lit("BEFORE def g_"), F.col("p_size").cast("string"), F.lit("(x):\nAFTER def  h (y):\ndef g_"), F.col("p_size").cast("string"), F.lit("(x, y):"))
    return t.part.select("p_partkey", F.array_join(T.defined_names(pairs), ",").alias("names"))


# --------------------------------------------------------------- answers to edits


def answers(t: Tables) -> DataFrame:
    """(query_id, answer): an edit of the part's file in each of five forms."""
    k = F.col("p_partkey").cast("string")
    old = F.concat(F.lit("value = helper_"), (F.col("p_partkey") % 7).cast("string"), F.lit("(a)\nreturn self.store(value, b)"))
    new = F.concat(F.lit("value = other_"), k, F.lit("(a)\nreturn value"))
    whole = F.concat(F.lit("def helper_"), k, F.lit("(x):\n    return x + "), k, F.lit("  # changed"))
    return _parts(t).select(
        F.col("p_partkey").alias("query_id"),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("BEFORE:\n```python\n"), old, F.lit("\n```\nAFTER:\n```python\n"), new, F.lit("\n```")))
        .when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("```python\n# BEFORE\n"), old, F.lit("\n# AFTER\n"), new, F.lit("\n```")))
        .when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("<BEFORE>\n"), old, F.lit("\n</BEFORE>\n<AFTER>\n"), new, F.lit("\n</AFTER>")))
        .when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("Take\n```python\n"), whole, F.lit("\n```")))
        .otherwise(F.lit("I would not change it.")).alias("answer"),
    )


_OLD = "'value = helper_' || (p_partkey % 7) || '(a)' || chr(10) || 'return self.store(value, b)'"
_NEW = "'value = other_' || p_partkey || '(a)' || chr(10) || 'return value'"
_WHOLE = "'def helper_' || p_partkey || '(x):' || chr(10) || '    return x + ' || p_partkey || '  # changed'"


@query("a125_edit_pairs", f"SELECT p_partkey AS query_id, CASE WHEN p_partkey % 5 = 3 THEN '' ELSE {_OLD} END AS before, CASE WHEN p_partkey % 5 = 3 THEN {_WHOLE} ELSE {_NEW} END AS after, CASE WHEN p_partkey % 5 = 3 THEN 'helper_' || p_partkey END AS function FROM part WHERE p_partkey % 5 <> 4")
def a125(t: Tables) -> DataFrame:
    return S.parsed_edits(answers(t)).select("query_id", "before", "after", "function")


def _ranked(t: Tables) -> DataFrame:
    """Retrieved nodes of each query: the definitions of its own file, the function first."""
    rows = S.assembled(S.extract(files(t)), include_classes=False)
    return rows.select(F.regexp_extract("file", r"m(\d+)", 1).cast("long").alias("query_id"), F.when(F.col("type") == "function", 1).otherwise(2).cast("long").alias("rank"), "file", "start_line", F.col("source_code").alias("source"))


@query("a126_completed_edits", f"SELECT p_partkey AS query_id, CASE WHEN p_partkey % 5 = 3 THEN CASE WHEN p_partkey % 50 = 0 THEN '' ELSE 'def helper_' || p_partkey || '(x):' || chr(10) || '    return x' END ELSE {_OLD} END AS before, CASE WHEN p_partkey % 5 = 3 THEN {_WHOLE} ELSE {_NEW} END AS after FROM part WHERE p_partkey % 5 <> 4")
def a126(t: Tables) -> DataFrame:
    return S.completed_edits(S.parsed_edits(answers(t)), _ranked(t)).select("query_id", "before", "after")


_FOUND = "part WHERE p_partkey % 5 <> 4"


@query(
    "a128_located_edits",
    f"""SELECT p_partkey AS query_id, CASE WHEN p_partkey % 50 <> 0 THEN 'src/m' || p_partkey || '.py' END AS file, CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 5 = 3 THEN 11 ELSE 7 END AS line,
CASE WHEN p_partkey % 50 = 0 THEN 'not_found' WHEN p_partkey % 5 = 3 THEN 'exact' ELSE 'indent_corrected' END AS status FROM {_FOUND}""",
)
def a128(t: Tables) -> DataFrame:
    # Both are read several times; files are parsed once.
    ranked = cut(_ranked(t), "ranked")
    edits = cut(S.completed_edits(S.parsed_edits(answers(t)), ranked), "edits")
    found = S.locate(edits, ranked, files(t).withColumnRenamed("path", "file"))
    return found.join(edits.select("query_id", "edit_id"), "edit_id").select("query_id", "file", "line", "status")


@query("a127_anchors", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'indent_corrected' WHEN 2 THEN 'fuzzy' ELSE 'not_found' END AS status, CASE p_partkey % 4 WHEN 0 THEN 11 WHEN 1 THEN 7 WHEN 2 THEN 8 END AS line FROM part WHERE p_partkey % 50 <> 0")
def a127(t: Tables) -> DataFrame:
    """Blocks as they stand, moved, with a wrong line among them, and with other inner nesting."""
    m = (F.col("p_partkey") % 7).cast("string")
    before = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("def helper_"), F.col("p_partkey").cast("string"), F.lit("(x):\n    return x")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("value = helper_"), m, F.lit("(a)\nreturn self.store(value, b)")))
        .when(F.col("p_partkey") % 4 == 2, F.lit("# somewhere in the middle of it\nvalues = None\nreturn self.store(value, b)\npass"))
        .otherwise(F.concat(F.lit("value = h"), m, F.lit("\n    return w")))
    )
    edits = t.part.filter("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("edit_id"), F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"), before.alias("before"))
    texts = files(t).select(F.col("path").alias("key"), F.col("path").alias("file"), F.lit(1).cast("long").alias("rank"), F.lit(1).cast("long").alias("start_line"), "content")
    found = S.find_edits(edits.withColumnRenamed("file", "key"), texts, "key").select("edit_id", "status", "line")
    return edits.select("edit_id").join(found, "edit_id", "left").select(F.col("edit_id").alias("p_partkey"), F.coalesce("status", F.lit("not_found")).alias("status"), "line")


@query("a129_aligned", "SELECT p_partkey, repeat(' ', (p_size % 5)::INT) || 'if x:' || chr(10) || repeat(' ', (p_size % 5 + 2)::INT) || 'y' AS text FROM part")
def a129(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.aligned(F.lit("   if x:\n     y"), F.col("p_size") % 5 - 3).alias("text"))


@query(
    "a129_aligned_texts",
    "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_full_match(x, '[ \\t\\r]*') THEN x WHEN doc_id % 7 > 3 THEN repeat(' ', (doc_id % 7 - 3)::INT) || x "
    "ELSE substr(x, (1 + least(3 - doc_id % 7, length(regexp_extract(x, '^[ \\t\\r]*'))))::INT) END), chr(10)) AS text FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10) || '  ') AS text FROM documents)",
)
def a129_texts(t: Tables) -> DataFrame:
    """Every document as a block, a sentence a line, moved by -3 to 3 columns."""
    blocks = t.documents.select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n  ")).alias("text"))
    return blocks.select("doc_id", S.aligned(F.col("text"), F.col("doc_id") % 7 - 3).alias("text"))


_DIFF_PATH = "'src/m' || p_partkey || '.py'"
_HUNK = lambda *rows: " || chr(10) || ".join(rows)


@query(
    "a130_unified_diff",
    "SELECT path, 'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -4,8 +4,8 @@' || chr(10) || ' ' || chr(10) || ' ' || '        Of size ' || p_size || '.' || chr(10) || ' ' || '        \"\"\"' || chr(10) "
    "|| '-        value = helper_' || (p_partkey % 7) || '(a)' || chr(10) || '-        return self.store(value, b)' || chr(10) || '+        value = other_' || p_partkey || '(a)' || chr(10) || '+        return value' || chr(10) || ' ' || chr(10) || ' ' || chr(10) || ' def helper_' || p_partkey || '(x):' || chr(10) AS diff, "
    f"'indent_corrected' AS statuses FROM (SELECT *, {_DIFF_PATH} AS path FROM part) WHERE p_partkey % 5 < 3 AND p_partkey % 50 <> 0",
)
def a130(t: Tables) -> DataFrame:
    path = F.concat(F.lit("src/m"), F.col("query_id").cast("string"), F.lit(".py"))
    asked = answers(t).filter("query_id % 5 < 3 and query_id % 50 <> 0").select(path.alias("path"), "answer")
    return S.diffs(asked, files(t)).select("path", "diff", F.array_join("statuses", ",").alias("statuses"))


@query("a131_answers_to_diffs", "SELECT 'src/m' || p_partkey || '.py' AS path, 1 AS n_edits, p_partkey % 50 <> 0 AS changed FROM part WHERE p_partkey % 5 <> 4")
def a131(t: Tables) -> DataFrame:
    """Answer to edits, whole functions completed, located, one diff a file."""
    edits = S.completed_edits(S.parsed_edits(answers(t)), _ranked(t))
    block = F.concat(F.lit("<<<<<<< SEARCH\n"), "before", F.lit("\n=======\n"), "after", F.lit("\n>>>>>>> REPLACE"))
    asked = edits.select(F.concat(F.lit("src/m"), F.col("query_id").cast("string"), F.lit(".py")).alias("path"), block.alias("answer"))
    out = S.diffs(asked, files(t))
    return out.select("path", F.size("statuses").alias("n_edits"), (F.col("diff") != "").alias("changed"))


@query("a171_first_by_name", f"WITH {_DEFS} SELECT 'helper_' || p_partkey AS name, {_ID.replace(chr(39) + 'lib/' + chr(39) + ' || ', '')} || '__helper_' || p_partkey AS id FROM files WHERE p_size > 25")
def a171(t: Tables) -> DataFrame:
    rows = S.assembled(S.extract(files(t))).select("id", "file", F.substring_index("qualified_name", ".", -1).alias("name"), F.col("start_line").alias("pos"))
    wanted = t.part.select(F.concat(F.lit("helper_"), F.col("p_partkey").cast("string")).alias("name"))
    within = t.part.filter("p_size > 25").select(F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"))
    return similarity.first_by_name(rows, wanted, within)
