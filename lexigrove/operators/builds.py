"""Building hierarchies: what is left to build, parents and children, links, prompts, responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions.text import normalize_id
from lexigrove.operators import graph


def hierarchy_ids(hierarchy: DataFrame) -> DataFrame:
    """(id) of all topics and concepts of (topic, concepts), normalized, each once, in order."""
    names = hierarchy.select(F.explode(F.concat(F.array("topic"), F.coalesce("concepts", F.array().cast("array<string>")))).alias("name"))
    return names.select(normalize_id(F.col("name")).alias("id")).distinct().orderBy("id")


def require_keys(rows: DataFrame, *names: str) -> DataFrame:
    """The rows; a column that is missing is an error that names it."""
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise KeyError(f"missing: {', '.join(missing)}")
    return rows


def not_built(hierarchy: DataFrame, stored: DataFrame) -> DataFrame:
    """(topic, concepts, skipped): concepts whose id is not stored, in order; topics stay without any.

    ``hierarchy`` gives (topic, concepts), ``stored`` (id).
    """
    each = hierarchy.select("topic", F.posexplode("concepts").alias("pos", "concept")).withColumn("id", normalize_id(F.col("concept")))
    told = each.join(stored.select("id", F.lit(True).alias("built")).distinct(), "id", "left")
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("built").isNull(), F.struct("pos", "concept")))), lambda x: x["concept"])
    lists = told.groupBy("topic").agg(kept.alias("concepts"), F.count("built").alias("skipped"))
    return hierarchy.select("topic").join(lists, "topic", "left").withColumns({"concepts": F.coalesce("concepts", F.array().cast("array<string>")), "skipped": F.coalesce("skipped", F.lit(0))})


def build_hierarchy(hierarchy: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, title, parent_id, children_ids) of all topics and concepts.

    A topic that is listed as a concept has that parent (the last of several);
    others are roots. Children are those stored before, then the new ones in
    order, each once. ``hierarchy`` gives (pos, topic, concepts), ``stored``
    (id, children_ids).
    """
    named = hierarchy.select("pos", F.col("topic").alias("title"), F.lit(None).cast("string").alias("parent"), F.lit(-1).alias("at"))
    listed = hierarchy.select("pos", F.col("topic").alias("parent"), F.posexplode("concepts").alias("at", "title")).select("pos", "title", "parent", "at")
    every = named.unionByName(listed).withColumn("id", normalize_id(F.col("title")))
    # The last place that gives a parent decides.
    of = every.groupBy("id").agg(F.min_by("title", F.struct("pos", "at")).alias("title"), F.max_by("parent", F.when(F.col("parent").isNotNull(), F.struct("pos", "at"))).alias("parent"))
    new = listed.withColumn("id", normalize_id(F.col("parent"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "at", normalize_id(F.col("title")).alias("child")))).alias("c"))
    empty = F.array().cast("array<string>")
    joined = of.join(stored.select("id", F.col("children_ids").alias("before")), "id", "left").join(new, "id", "left")
    children = F.array_union(F.coalesce("before", empty), F.coalesce(F.transform("c", lambda x: x["child"]), empty))
    return joined.select("id", "title", normalize_id(F.col("parent")).alias("parent_id"), children.alias("children_ids"))


def linked(nodes: DataFrame) -> DataFrame:
    """Nodes (id, parent_id, children_ids, related) with the child links that parents lack, and without related ids that do not exist."""
    missing = graph.rebuild_children(nodes.select("id", "parent_id"), nodes.select("id", F.col("children_ids").alias("children"))).withColumnRenamed("children", "children_ids")
    known = nodes.select(F.col("id").alias("ref"))
    related = nodes.select("id", F.posexplode("related").alias("pos", "ref")).join(known, "ref", "left_semi")
    kept = related.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("related"))
    return nodes.drop("children_ids", "related").join(missing, "id").join(kept, "id", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def tree_of(nodes: DataFrame, child_edges: DataFrame, first: int = 5) -> tuple[DataFrame, DataFrame]:
    """The nodes as they are, and the first issues that validation finds: building is not strict."""
    return nodes, graph.validate(nodes, child_edges).orderBy("kind", "id", "other").limit(first)


def concept_rows(response: Column, limit: int = 500) -> tuple[Column, Column]:
    """(problem to concepts as a map, new concepts) of a grounding response that :func:`balanced_json` gave."""
    told = F.from_json(response, "problem_to_concepts map<string,array<string>>, new_concepts_needed array<struct<name:string,topic:string,rationale:string>>")
    return told["problem_to_concepts"], told["new_concepts_needed"]


def problem_listing(problem_id: Column, answer: Column, question: Column, limit: int = 500) -> Column:
    """A problem in a prompt: its id, its answer, and the first characters of its text."""
    return F.concat(F.lit("### Problem "), problem_id, F.lit(" (gt="), answer, F.lit("):\n"), F.substring(question, 1, limit))


def whitelist_rows(ids: DataFrame, own: str, per_row: int = 4) -> DataFrame:
    """(row, ids) of a white list in a prompt: ids in order without the node's own, four to a row, by ``own``."""
    at = F.row_number().over(Window.partitionBy(own).orderBy("id")) - 1
    rows = ids.filter(F.col("id") != F.col(own)).withColumn("row", F.floor(at / per_row).cast("int"))
    return rows.groupBy(own, "row").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids"))


def enriched(nodes: DataFrame, answers: DataFrame, column: str, kinds: tuple[str, ...], limit: int = 4_000) -> DataFrame:
    """Nodes whose empty ``column`` is filled from (id, answer), for these types and for sources of at most ``limit`` characters' prompt."""
    joined = nodes.join(answers.select("id", F.col("answer").alias("__answer")), "id", "left")
    empty = F.coalesce(F.trim(column), F.lit("")) == ""
    return joined.withColumn(column, F.when(empty & F.col("type").isin(*kinds), F.col("__answer")).otherwise(F.col(column))).withColumn("prompt", F.substring("source_code", 1, limit)).drop("__answer")


def replaced_examples(nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, example, status) of an audited replacement: kept, replaced, failed or rejected by the check.

    ``answers`` gives (id, example, agrees): no answer is a failure, an answer
    that its check does not confirm is rejected; both keep the old example.
    """
    joined = nodes.join(answers.select("id", F.col("example").alias("__new"), "agrees", F.lit(True).alias("__asked")), "id", "left")
    status = F.when(F.col("__asked").isNull(), "kept").when(F.coalesce(F.trim("__new"), F.lit("")) == "", "failed").when(F.col("agrees"), "replaced").otherwise("rejected")
    return joined.withColumn("status", status).select("id", F.when(F.col("status") == "replaced", F.col("__new")).otherwise(F.col("example")).alias("example"), "status")


def checked_node(answer: Column) -> tuple[Column, Column]:
    """(node, fault) of a build answer: the fields it must have, or the first that is missing or too short."""
    node = F.from_json(answer, "title string, definition string, key_facts array<string>, worked_examples array<string>, common_pitfalls array<string>")
    n = lambda c: F.coalesce(F.size(node[c]), F.lit(0))
    fault = (
        F.when(node.isNull() | node["title"].isNull(), "title").when(F.coalesce(F.trim(node["definition"]), F.lit("")) == "", "definition")
        .when(n("key_facts") < 2, "key_facts").when(n("worked_examples") < 1, "worked_examples")
    )
    return node, fault


def call_outcome(status: Column, text: Column, attempt: Column, most: int = 3) -> Column:
    """What to do with a responder's reply: done, retry or fail.

    Too many requests, server errors, a lost connection (null status) and an
    empty text are tried again up to ``most`` times; refused or unknown requests are not.
    """
    again = F.when(attempt < most, "retry").otherwise("fail")
    return F.when(status.isNull() | status.isin(429, 529) | status.between(500, 599), again).when(status != 200, "fail").when(F.coalesce(F.trim(text), F.lit("")) == "", again).otherwise("done")
