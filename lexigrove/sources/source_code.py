"""Definitions of Python files as rows, and edits to files from model answers.

Files are parsed where they lie (one Arrow batch at a time); a file that does
not parse gives one rejected row instead of failing the job.
"""

from __future__ import annotations

import ast
import difflib
import re
import textwrap
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.sources.scratch import cut

DEFINITIONS = (
    "path string, pos int, kind string, name string, qualified_name string, parent_class string, parent_function string, start_line int, end_line int, "
    "signature string, params array<string>, docstring string, source string, calls array<string>, error string"
)


def scan_files(spark: SparkSession, root: str, glob: str = "*.py", ignore: tuple[str, ...] = (), max_files: int | None = None) -> DataFrame:
    """(path, content) of the files below a folder, without those that a pattern ignores."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = files.select("path", F.decode("content", "UTF-8").alias("content"))
    for pattern in ignore:
        rows = rows.filter(~ignored(F.col("path"), pattern))
    return rows if max_files is None else rows.orderBy("path").limit(max_files)


def ignored(path: Column, pattern: str) -> Column:
    """``dir/`` matches a path segment, ``*`` a pattern within a segment, anything else a part of the path."""
    if pattern.endswith("/"):
        return F.contains(F.concat(F.lit("/"), path), F.lit("/" + pattern))
    if "*" in pattern:
        rx = "^" + ".*".join(map(re.escape, pattern.split("*"))) + "$"
        return F.exists(F.split(path, "/"), lambda s: s.rlike(rx))
    return F.contains(path, F.lit(pattern))


def called(node: ast.AST) -> list[str]:
    """Names that a definition's body calls, in order, each once; of ``a.b.c()`` the last."""
    names: dict[str, None] = {}
    calls = [c for part in node.body for c in ast.walk(part) if isinstance(c, ast.Call)]
    for c in sorted(calls, key=lambda c: (c.lineno, c.col_offset)):
        if isinstance(c.func, ast.Name):
            names[c.func.id] = None
        elif isinstance(c.func, ast.Attribute):
            names[c.func.attr] = None
    return list(names)


def definitions(path: str, content: str) -> list[dict]:
    """Functions, classes, methods and nested functions of one file."""
    empty = dict.fromkeys(f.split()[0] for f in DEFINITIONS.split(", "))
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as e:
        return [empty | {"path": path, "pos": 0, "kind": "rejected", "error": str(e)}]
    lines, out = content.split("\n"), []

    def visit(node: ast.AST, cls: str | None, function: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "sub_function" if function else "method" if cls else "function"
                # Within a function's body a class stands on its own.
                name = f"{cls}.{child.name}" if cls else f"{function}.{child.name}" if function and not is_class else child.name
                head = lines[child.lineno - 1 : child.body[0].lineno]
                if child.body[0].lineno == child.lineno:
                    head = head[:1]
                else:
                    head = head[:-1] or head
                out.append(empty | {
                    "path": path, "pos": len(out), "kind": kind, "name": child.name, "qualified_name": name, "parent_class": cls, "parent_function": None if is_class else function,
                    "start_line": child.lineno, "end_line": child.end_lineno, "signature": re.sub(r"\s+", " ", " ".join(head)).strip(),
                    "params": [] if is_class else [a.arg for a in [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs]],
                    "docstring": ast.get_docstring(child), "source": "\n".join(lines[child.lineno - 1 : child.end_lineno]), "calls": called(child),
                })
                visit(child, child.name if is_class else None, None if is_class else child.name)
            else:
                visit(child, cls, function)

    visit(tree, None, None)
    return out


def extract(files: DataFrame) -> DataFrame:
    """(path, content) to one row a definition, or a rejected row with the error."""
    names = [f.split()[0] for f in DEFINITIONS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [d for path, content in zip(frame["path"], frame["content"], strict=True) for d in definitions(path, content or "")]
            out = pd.DataFrame(rows, columns=names)
            for c in ("start_line", "end_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(run, DEFINITIONS)


def node_id(path: str = "path", name: str = "qualified_name") -> Column:
    """Base id of a definition: path and name, lower case, separators to underscores."""
    return F.lower(F.concat(F.translate(path, "/.", "__"), F.lit("__"), F.col(name)))


# ----------------------------------------------------------------- doc strings


def sections(doc: str | None) -> dict[str, str]:
    """Sections of a docstring whose headings are underlined; what comes before the first is ``summary``."""
    out: dict[str, list[str]] = {"summary": []}
    lines, at = textwrap.dedent(doc or "").strip().split("\n"), "summary"
    k = 0
    while k < len(lines):
        if k + 1 < len(lines) and lines[k].strip() and re.fullmatch(r"\s*-{3,}\s*", lines[k + 1]):
            at = lines[k].strip().lower()
            out[at] = []
            k += 2
            continue
        out[at].append(lines[k])
        k += 1
    return {name: "\n".join(body).strip() for name, body in out.items()}


def doctests(doc: str | None) -> list[dict]:
    """(code, output) of the ``>>>`` examples of a docstring."""
    out: list[dict] = []
    code: list[str] = []
    said: list[str] = []

    def close() -> None:
        if code:
            out.append({"code": "\n".join(code), "output": "\n".join(said).strip()})
        code.clear()
        said.clear()

    for line in (doc or "").split("\n"):
        text = line.strip()
        if text.startswith(">>>"):
            if said:
                close()
            code.append(text[3:].lstrip(" "))
        elif text.startswith("...") and code and not said:
            code.append(text[3:][1:] if text[3:4] == " " else text[3:])
        elif not text:
            close()
        elif code:
            said.append(text)
    close()
    return out


# ------------------------------------------------------- answers to file edits

_FENCE = r"```(?:python|py|diff)?[ \t]*\n"
_PAIR_FORMS = (
    re.compile(rf"BEFORE\s*:?\s*\n{_FENCE}(.*?)\n```\s*AFTER\s*:?\s*\n{_FENCE}(.*?)\n```", re.S | re.I),
    re.compile(rf"{_FENCE}(?:#\s*)?BEFORE\s*\n(.*?)\n(?:#\s*)?AFTER\s*\n(.*?)\n```", re.S | re.I),
    re.compile(r"<before>\s*?\n?(.*?)\n?[ \t]*</before>\s*<after>\s*?\n?(.*?)\n?[ \t]*</after>", re.S | re.I),
    re.compile(r"<<<<<<< SEARCH\n(.*?)\n=======\n(.*?)\n>>>>>>> REPLACE", re.S),
)
_WHOLE = re.compile(rf"{_FENCE}(def\s+\w+\s*\(.*?)\n```", re.S | re.I)
_DEF = re.compile(r"\s*def\s+(\w+)\s*\(")
#: Characters of a function that is taken as a whole, and of a line that may stand for a block.
WHOLE_CHARS, ANCHOR_CHARS = 30, 15
_COMMON = frozenset(("pass", "continue", "break", "return", "else:", "try:", "except:"))


def edit_pairs(answer: str | None) -> list[tuple[str, str]]:
    """(before, after) texts of an answer, by the first form that has any.

    Forms: two fenced blocks, one block with BEFORE and AFTER lines, tags,
    conflict marks; else whole functions, with an empty ``before``.
    """
    for form in _PAIR_FORMS:
        found = [(a.strip("\n"), b.strip("\n")) for a, b in form.findall(answer or "") if a.strip() and b.strip()]
        if found:
            return found
    return [("", x.rstrip("\n")) for x in _WHOLE.findall(answer or "") if len(x.rstrip("\n")) >= WHOLE_CHARS]


def whole_function(before: str, after: str) -> str | None:
    """Name of the function that an edit replaces as a whole, if it does.

    It does if there is no ``before``, or if both texts start with the
    definition of one function, whose ``before`` may then be incomplete.
    """
    new, old = _DEF.match(after), _DEF.match(before)
    if not new or len(after) < WHOLE_CHARS or before.strip() and (not old or old[1] != new[1]):
        return None
    return new[1]


def completed(before: str, after: str, body: str | None) -> tuple[str, str]:
    """The edit with the retrieved body of its function as ``before``, and ``after`` moved to its indentation."""
    if body is None or not whole_function(before, after):
        return before, after
    return body, shift(after, uniform(body)[1] - uniform(after)[1])


def uniform(text: str) -> tuple[str, int]:
    """Text without the indentation that all its lines with content share, and its width."""
    lines = text.split("\n")
    width = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
    return "\n".join(x[width:] if x.strip() else x for x in lines), width


def indent_of(text: str) -> int:
    """Indentation of the first line with content."""
    return next((len(x) - len(x.lstrip()) for x in text.split("\n") if x.strip()), 0)


def shift(text: str, delta: int) -> str:
    """Move all lines with content by ``delta`` columns, not beyond the margin."""
    move = lambda x: x if not x.strip() else " " * delta + x if delta > 0 else x[min(-delta, len(x) - len(x.lstrip())) :]
    return "\n".join(map(move, text.split("\n")))


def aligned(text: Column, delta: Column) -> Column:
    """:func:`shift` of a column: lines with content moved by ``delta`` columns, not beyond the margin."""
    delta = delta.cast("int")
    width = lambda x: F.length(F.regexp_extract(x, r"^[ \t\r]*", 0))
    move = lambda x: F.when(F.rtrim(F.regexp_replace(x, r"[\t\r]", " ")) == "", x).when(delta > 0, F.concat(F.repeat(F.lit(" "), delta), x)).otherwise(F.substr(x, F.least(-delta, width(x)) + 1))
    return F.array_join(F.transform(F.split(text, "\n", -1), move), "\n")


def find_anchor(source: str, before: str) -> tuple[int, str, str]:
    """(offset or -1, matched text, status): exact at a line start, indent_corrected, fuzzy, or not_found.

    indent_corrected moves the whole block by one width, so its inner nesting
    must be that of the source. fuzzy stands for a block by its longest line of
    15 characters or more that is no comment and no common keyword, where it
    occurs first.
    """
    if not before.strip():
        return -1, "", "not_found"
    at = source.find(before)
    while at > 0 and source[at - 1] != "\n":
        at = source.find(before, at + 1)
    if at >= 0:
        return at, before, "exact"
    lines, wanted = source.split("\n"), before.strip("\n").split("\n")
    offset = lambda k: sum(len(x) + 1 for x in lines[:k])
    width = lambda x: len(x) - len(x.lstrip(" "))
    for k in range(len(lines) - len(wanted) + 1):
        if lines[k].strip() == wanted[0].strip():
            moved = shift("\n".join(wanted), width(lines[k]) - width(wanted[0])).split("\n")
            if all(a.rstrip() == b.rstrip() for a, b in zip(moved, lines[k : k + len(wanted)], strict=True)):
                return offset(k), "\n".join(lines[k : k + len(wanted)]), "indent_corrected"
    telling = [x.strip() for x in wanted if len(x.strip()) >= ANCHOR_CHARS and not x.strip().startswith("#") and x.strip() not in _COMMON]
    if telling:
        line = max(telling, key=len)
        hit = next((k for k, x in enumerate(lines) if x.strip() == line), None)
        if hit is not None:
            return offset(hit), lines[hit], "fuzzy"
    return -1, "", "not_found"


def unified_diff(path: str, source: str, pairs: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """Diff of all edits that are found, applied from the bottom up, and each edit's status."""
    found = [(*find_anchor(source, before), after) for before, after in pairs]
    new = source
    for at, matched, _, after in sorted(found, key=lambda x: -x[0]):
        if at >= 0:
            new = new[:at] + shift(after, indent_of(matched) - indent_of(after)) + new[at + len(matched) :]
    body = "\n".join(difflib.unified_diff(source.split("\n"), new.split("\n"), f"a/{path}", f"b/{path}", lineterm="", n=3))
    return (f"diff --git a/{path} b/{path}\n{body}\n" if body else ""), [x[2] for x in found]


def diffs(answers: DataFrame, files: DataFrame) -> DataFrame:
    """(path, diff, statuses): answers (path, answer) joined to files (path, content), one diff a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *unified_diff(path, content, [p for a in told for p in edit_pairs(a)])) for path, content, told in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "diff", "statuses"])

    # Texts are made of short rows, so sizes told from those are far too small: neither side is broadcast, whose table the driver would hold.
    # Groups are lists of a few answers; batches of them go to Python, not each by itself.
    told = answers.join(files.hint("merge"), "path").groupBy("path").agg(F.first("content").alias("content"), F.collect_list("answer").alias("told"))
    return told.select("path", "content", "told").mapInPandas(run, "path string, diff string, statuses array<string>")


def find_edits(edits: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(edit_id, rank, file, line, matched, status) where the ``before`` of an edit is found in a text with the same ``key``.

    ``edits`` gives (edit_id, before), ``texts`` (rank, file, start_line, content).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for e, rank, file, start, before, content in frame.itertuples(index=False):
                at, matched, status = find_anchor(content or "", before or "")
                if at >= 0:
                    rows.append((e, rank, file, start + content.count("\n", 0, at), matched, status))
            yield pd.DataFrame(rows, columns=["edit_id", "rank", "file", "line", "matched", "status"])

    pairs = edits.join(texts, key).select("edit_id", "rank", "file", "start_line", "before", "content")
    return pairs.mapInPandas(run, "edit_id long, rank long, file string, line long, matched string, status string")


def locate(edits: DataFrame, ranked: DataFrame, files: DataFrame) -> DataFrame:
    """(edit_id, file, line, matched, status): the first retrieved node with the text, else the first of their files, else not_found.

    ``edits`` gives (query_id, edit_id, before); ``ranked`` (query_id, rank,
    file, start_line, source) gives the retrieved nodes; ``files`` (file, content).
    """
    best = lambda df: df.groupBy("edit_id").agg(F.min_by(F.struct("file", "line", "matched", "status"), "rank").alias("m")).select("edit_id", "m.*")
    texts = ranked.filter("file is not null and coalesce(source, '') <> ''")
    # Read twice: nodes are searched once.
    near = cut(best(find_edits(edits, texts.select("query_id", F.col("rank").cast("long").alias("rank"), "file", F.coalesce(F.col("start_line"), F.lit(1)).cast("long").alias("start_line"), F.col("source").alias("content")), "query_id")), "near")
    left = edits.join(near, "edit_id", "left_anti")
    # Only files of queries with an edit left are fetched.
    once = ranked.filter("file is not null").join(left.select("query_id"), "query_id", "left_semi").groupBy("query_id", "file").agg(F.min("rank").cast("long").alias("rank")).join(files, "file")
    far = best(find_edits(left, once.select("query_id", "rank", "file", F.lit(1).cast("long").alias("start_line"), "content"), "query_id"))
    return edits.select("edit_id").join(near.unionByName(far), "edit_id", "left").na.fill({"status": "not_found"})


def parsed_edits(answers: DataFrame) -> DataFrame:
    """(query_id, answer) to (query_id, edit_id, before, after, function), one row an edit in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(q, q * 1_000 + k, a, b, whole_function(a, b)) for q, answer in zip(frame["query_id"], frame["answer"], strict=True) for k, (a, b) in enumerate(edit_pairs(answer))]
            yield pd.DataFrame(rows, columns=["query_id", "edit_id", "before", "after", "function"])

    return answers.select("query_id", "answer").mapInPandas(run, "query_id long, edit_id long, before string, after string, function string")


def completed_edits(edits: DataFrame, ranked: DataFrame) -> DataFrame:
    """Edits with ``before`` and ``after`` of whole functions taken from the first retrieved node of that name."""
    name = F.regexp_extract("source", r"^\s*def\s+(\w+)\s*\(", 1)
    bodies = ranked.select("query_id", name.alias("function"), "rank", "source").filter("function <> ''").groupBy("query_id", "function").agg(F.min_by("source", "rank").alias("body"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [completed(a, b, body if isinstance(body, str) else None) for a, b, body in zip(frame["before"], frame["after"], frame["body"], strict=True)]
            yield frame.assign(before=[x[0] for x in made], after=[x[1] for x in made])[["query_id", "edit_id", "before", "after", "function"]]

    # As in ``diffs``, a body is longer than the row it is made of: it is not broadcast.
    joined = edits.join(bodies.hint("merge"), ["query_id", "function"], "left").select("query_id", "edit_id", "before", "after", "function", "body")
    return joined.mapInPandas(run, "query_id long, edit_id long, before string, after string, function string")


def docstring_parts(rows: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, section, body) of every section of a docstring."""
    return _exploded(rows, key, doc, lambda x: list(sections(x).items()), ("section", "body"))


def docstring_examples(rows: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, code, output) of every example of a docstring."""
    return _exploded(rows, key, doc, lambda x: [(e["code"], e["output"]) for e in doctests(x)], ("code", "output"))


def _exploded(rows: DataFrame, key: str, doc: str, parts: Callable[[str], list[tuple[str, str]]], names: tuple[str, str]) -> DataFrame:
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, i, *x) for k, text in zip(frame[key], frame[doc], strict=True) for i, x in enumerate(parts(text))]
            yield pd.DataFrame(out, columns=[key, "pos", *names])

    return rows.select(key, doc).mapInPandas(run, f"{key} {kind}, pos int, {names[0]} string, {names[1]} string")


# ------------------------------------------------------------- nodes from definitions


def assembled(found: DataFrame, include_classes: bool = True, include_sub_functions: bool = False, path_prefix: str = "") -> DataFrame:
    """Nodes of definitions: title, definition with its fall-back, key facts, parent, place.

    Classes and nested functions can be left out; ``path_prefix`` goes before
    every path.
    """
    rows = found.filter("kind <> 'rejected'")
    for kind, wanted in (("class", include_classes), ("sub_function", include_sub_functions)):
        rows = rows if wanted else rows.filter(F.col("kind") != kind)
    path = F.concat(F.lit(path_prefix), F.col("path")) if path_prefix else F.col("path")
    has_doc = F.coalesce("docstring", F.lit("")) != ""
    first = F.element_at(F.split("docstring", "\n\n", 2), 1)
    facts = F.array(
        F.concat(F.lit("Signature: "), "signature"), F.concat(F.lit("Location: "), path, F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")),
        F.concat(F.lit("Type: "), "kind"), F.when(has_doc & (first != "") & (first != F.col("docstring")), F.concat(F.lit("Description: "), F.substring(first, 1, 300))),
    )
    file_id = F.lower(F.translate(path, "/.", "__"))
    return rows.select(
        F.concat(file_id, F.lit("__"), F.lower("qualified_name")).alias("id"),
        F.substring(F.concat("kind", F.lit(": "), "qualified_name", F.lit("("), F.array_join("params", ", "), F.lit(")")), 1, 200).alias("title"),
        F.when(has_doc, F.col("docstring")).otherwise(F.concat_ws(" ", "kind", "qualified_name", F.lit("in"), path)).alias("definition"),
        F.filter(facts, lambda x: x.isNotNull()).alias("key_facts"),
        F.when(F.col("parent_class").isNotNull(), F.concat(file_id, F.lit("__"), F.lower("parent_class"))).otherwise(file_id).alias("parent_id"),
        path.alias("file"), "start_line", "end_line", F.col("kind").alias("type"), "qualified_name", F.col("source").alias("source_code"), "calls",
    )


def counters(files: DataFrame, found: DataFrame, built: DataFrame) -> DataFrame:
    """(n_files, n_parsed, n_errors, n_built, n_skipped) of a build, as one row."""
    one = lambda df, **c: df.agg(*(v.alias(k) for k, v in c.items()))
    n = F.count("*")
    rows = one(files, n_files=n).crossJoin(one(found, n_errors=F.count_if(F.col("kind") == "rejected"), n_found=F.count_if(F.col("kind") != "rejected"))).crossJoin(one(built, n_built=n))
    return rows.select("n_files", (F.col("n_files") - F.col("n_errors")).alias("n_parsed"), "n_errors", "n_built", (F.col("n_found") - F.col("n_built")).alias("n_skipped"))


def sub_chunk(source: Column, head: int = 40, tail: int = 10, above: int = 100) -> Column:
    """A source of more than ``above`` lines as its first and last ones around a mark; others whole."""
    lines = F.split(source, "\n", -1)
    mark = F.concat(F.lit("\n\n# ... ("), F.size(lines).cast("string"), F.lit(" total lines, middle truncated) ...\n\n"))
    cut = F.concat(F.array_join(F.slice(lines, 1, head), "\n"), mark, F.array_join(F.slice(lines, -tail, tail), "\n"))
    return F.when(F.size(lines) > above, cut).otherwise(source)
