"""Nodes: validation, projections, upserts and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions.text import first_line, shortened
from lexigrove.operators.scans import Parts

EXAMPLE = "struct<problem:string,solution_steps:array<string>,final_answer:string,key_insight:string>"
NODE_SCHEMA = (
    f"id string, title string, definition string, key_facts array<string>, worked_examples array<{EXAMPLE}>, common_pitfalls array<string>, "
    "parent_id string, children_ids array<string>, related_concepts array<string>, confidence double, source string, last_verified string, "
    "domain_metadata string, source_code string"
)


def _blank(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def invalid_reason() -> Column:
    """First reason for which a node is invalid; null if it is valid."""
    return (
        F.when(_blank("id"), "id").when(_blank("title"), "title").when(_blank("definition"), "definition")
        .when(F.coalesce(~F.col("confidence").between(0, 1) | F.isnan("confidence"), F.lit(False)), "confidence")
    )


def valid_examples(examples: Column) -> Column:
    """All worked examples have a problem, an answer and a step."""
    return F.forall(F.coalesce(examples, F.array().cast(f"array<{EXAMPLE}>")), lambda x: ~_blank(x["problem"]) & ~_blank(x["final_answer"]) & (F.size(x["solution_steps"]) > 0))


def assert_valid(nodes: DataFrame) -> DataFrame:
    """The nodes; running the plan fails on an invalid one."""
    reason = invalid_reason()
    return nodes.withColumn("id", F.when(reason.isNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("invalid node: "), reason)).cast("string")))


def index_text(with_summary: bool = False, with_class_summary: bool = False) -> Column:
    """Title, definition, key facts, related concepts and optional summaries, one a line; empty ones left out."""
    empty = F.array().cast("array<string>")
    more = [F.array(c) for c, on in (("llm_summary", with_summary), ("class_summary", with_class_summary)) if on]
    parts = F.concat(F.array("title", "definition"), F.coalesce("key_facts", empty), F.coalesce("related_concepts", empty), *more)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def inject_text() -> Column:
    """Markdown of a whole node: definition, facts, numbered examples, pitfalls, and the source code last."""
    line = F.lit("\n")
    bullets = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{head}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")))

    def example(x: Column, i: Column) -> Column:
        steps = F.array_join(F.transform(x["solution_steps"], lambda s, j: F.concat((j + 1).cast("string"), F.lit(". "), s)), "\n")
        insight = F.when(x["key_insight"] != "", F.concat(F.lit("\n_Key insight: "), x["key_insight"], F.lit("_"))).otherwise("")
        return F.concat(F.lit("**Example "), (i + 1).cast("string"), F.lit(":** "), x["problem"], line, line, F.lit("Solution:\n"), steps, F.lit("\nAnswer: "), x["final_answer"], insight, line)

    examples = F.when(F.size("worked_examples") > 0, F.concat(F.lit("### Worked Examples\n"), F.array_join(F.transform("worked_examples", example), "\n")))
    code = F.when(F.coalesce("source_code", F.lit("")) != "", F.concat(F.lit("### Source Code\n```python\n"), "source_code", F.lit("\n```")))
    return F.concat_ws("\n", F.concat(F.lit("## "), "title", line, line, "definition"), bullets("### Key Facts", F.col("key_facts")), examples, bullets("### Common Pitfalls", F.col("common_pitfalls")), code)


def rerank_line() -> Column:
    """Candidate line for reranking: definition of at most 200 characters and two key facts."""
    facts = F.array_join(F.slice(F.coalesce("key_facts", F.array().cast("array<string>")), 1, 2), "; ")
    return F.concat(F.lit("- "), F.col("id"), F.lit(": **"), F.col("title"), F.lit("** — "), shortened(first_line(F.col("definition")), 200), F.when(facts != "", F.concat(F.lit(" | "), facts)).otherwise(""))


def localize_line() -> Column:
    """Candidate line for localization: id, name, file, signature of 200 and definition of 120 characters at most."""
    return F.concat_ws(" | ", F.concat(F.lit("ID="), F.col("id")), "qualified_name", "file", F.substring("signature", 1, 200), F.substring(first_line(F.col("definition")), 1, 120))


# --------------------------------------------------------------------- changes


def upsert(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``changes`` replace those with the same key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def last_wins(rows: DataFrame, order: str, key: str = "id") -> DataFrame:
    """One row a key: the one that comes last."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def assert_new(base: DataFrame, added: DataFrame, key: str = "id") -> DataFrame:
    """The union; a key that is there already is an error."""
    if not added.join(base.select(key), key, "left_semi").isEmpty() or not added.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError("a node of that id exists")
    return base.unionByName(added)


def get(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node of an id; KeyError if there is none."""
    found = nodes.filter(F.col("id") == node_id)
    if found.isEmpty():
        raise KeyError(node_id)
    return found


def filter_by_metadata(nodes: DataFrame, **filters: object) -> DataFrame:
    """source, confidence_min, confidence_max, last_verified_after (later, never null); other filters are ignored."""
    tests = {
        "source": lambda v: F.col("source") == v,
        "confidence_min": lambda v: F.col("confidence") >= v,
        "confidence_max": lambda v: F.col("confidence") <= v,
        "last_verified_after": lambda v: F.col("last_verified") > v,
    }
    for name, value in filters.items():
        if name in tests and value is not None:
            nodes = nodes.filter(tests[name](value))
    return nodes


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(*keys), keys, "left_anti")


def unique_ids(rows: DataFrame, base: str, line: str, order: list[str]) -> DataFrame:
    """``id``: the base for the first row of a name, then with ``_l<line>``, then with a counter as well."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    again = F.row_number().over(Window.partitionBy(base, line).orderBy(*order))
    suffix = F.when(F.col("__n") == 1, "").otherwise(F.concat(F.lit("_l"), F.col(line).cast("string"), F.when((F.col("__m") > 1) & (F.col("__n") > 1), F.concat(F.lit("_"), F.col("__m").cast("string"))).otherwise("")))
    return rows.withColumn("__n", n).withColumn("__m", again).withColumn("id", F.concat(F.col(base), suffix)).drop("__n", "__m")


def within_budget(rows: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of a group in order until the next would pass the budget; all after that are left out. Sizes are not negative."""
    return Parts(rows, [group], order).running(__total=("sum", F.col(size))).filter(F.col("__total") <= budget).drop("__total")
