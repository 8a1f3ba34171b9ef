"""Rank fusion, candidate selection and filters by a model's answers.

Model calls are relations: a response column comes in, and what surrounds it
(parsing, id checks, fall-backs, order) is relational.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(rankings: DataFrame, n: int = 10, k: int = RRF_K, decimals: int = 9) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_no, id, rank), rank from 1: (query_id, id, rrf, rank).

    Ties go to what appeared first: the earlier list, then the earlier rank.
    """
    fused = rankings.groupBy("query_id", "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), decimals).alias("rrf"), F.min(F.struct("list_no", "rank")).alias("seen")
    )
    by = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "seen.list_no", "seen.rank", "id")
    return fused.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n).select("query_id", "id", "rrf", "rank")


def selected(candidates: DataFrame, responses: DataFrame, k: int) -> DataFrame:
    """What a model chose: (query_id, id, rank) in its order.

    ``candidates`` gives (query_id, id string), ``responses`` (query_id, ids);
    ids are cut to ``k`` before those that are no candidates are dropped.
    """
    chosen = responses.select("query_id", F.posexplode(F.slice("ids", 1, k)).alias("pos", "id"))
    return chosen.join(candidates.select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", "id", (F.col("pos") + 1).alias("rank"))


def reranked(candidates: DataFrame, responses: DataFrame, k: int) -> DataFrame:
    """Chosen candidates in the model's order, filled up from the candidates' own order: (query_id, id, rank).

    ``candidates`` gives (query_id, id, rank); a query without a response, or
    with no more than ``k`` candidates, keeps its order.
    """
    picks = responses.select("query_id", F.posexplode("ids").alias("pos", "id")).groupBy("query_id", "id").agg(F.min("pos").alias("pos"))
    size = F.count("*").over(Window.partitionBy("query_id"))
    joined = candidates.withColumn("n", size).join(picks, ["query_id", "id"], "left").withColumn("pos", F.when(F.col("n") > k, F.col("pos")))
    by = Window.partitionBy("query_id").orderBy(F.col("pos").asc_nulls_last(), "rank")
    return joined.withColumn("new", F.row_number().over(by)).filter(F.col("new") <= k).select("query_id", "id", F.col("new").alias("rank"))


def reordered(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """All candidates, chosen ones first: (query_id, id, rank). ``chosen`` gives (query_id, id, pos)."""
    joined = candidates.join(chosen.select("query_id", "id", "pos"), ["query_id", "id"], "left")
    by = Window.partitionBy("query_id").orderBy(F.col("pos").asc_nulls_last(), F.col("rank"))
    return joined.select("query_id", "id", F.row_number().over(by).alias("rank"))


def localized(candidates: DataFrame, responses: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank, fell_back): the chosen candidates, at most ``k``.

    With ``k`` candidates or fewer all stay; where no chosen id is valid the
    first ``k`` stay and ``fell_back`` is true. An answer that is no id counts
    as the place of a candidate, from 1, by its first number.
    """
    w = Window.partitionBy("query_id")
    numbered = candidates.withColumn("n", F.count("*").over(w)).withColumn("id", F.col("id").cast("string"))
    answers = responses.select("query_id", F.posexplode("ids").alias("pos", "answer"))
    direct = answers.join(numbered.select("query_id", F.col("id").alias("answer"), F.col("rank").alias("r")), ["query_id", "answer"]).select("query_id", "r", "pos")
    wrong = answers.join(numbered.select("query_id", F.col("id").alias("answer")), ["query_id", "answer"], "left_anti")
    place = F.expr("try_cast(nullif(regexp_extract(answer, '([0-9]+)', 1), '') as int)")
    by_place = wrong.select("query_id", place.alias("r"), "pos").join(numbered.select("query_id", F.col("rank").alias("r")), ["query_id", "r"]).select("query_id", "r", "pos")
    picks = direct.unionByName(by_place).groupBy("query_id", "r").agg(F.min("pos").alias("pos"))
    joined = numbered.join(picks.withColumnRenamed("r", "rank"), ["query_id", "rank"], "left")
    any_pick = F.max(F.col("pos").isNotNull().cast("int")).over(w) == 1
    joined = joined.withColumn("fell_back", (F.col("n") > k) & ~any_pick).withColumn("use", (F.col("n") <= k) | ~any_pick | F.col("pos").isNotNull())
    by = Window.partitionBy("query_id").orderBy(F.when(F.col("n") > k, F.col("pos")).asc_nulls_last(), "rank")
    return joined.filter("use").withColumn("new", F.row_number().over(by)).filter(F.col("new") <= k).select("query_id", "id", F.col("new").alias("rank"), "fell_back")


def self_knowledge(candidates: DataFrame, min_keep: int = 0) -> DataFrame:
    """Drop candidates that a model says it knows: (query_id, id, rank).

    ``candidates`` gives (query_id, id, rank, answer); YES drops, NO and null (a
    failed call) keep. With fewer than ``min_keep`` left, the earliest dropped
    ones return at the end.
    """
    w = Window.partitionBy("query_id")
    told = candidates.withColumn("drop", F.coalesce(F.col("answer") == "YES", F.lit(False)))
    told = told.withColumn("kept", F.sum((~F.col("drop")).cast("int")).over(w))
    told = told.withColumn("n", F.row_number().over(w.orderBy(F.col("drop").asc(), F.col("rank").asc())))
    return told.filter(~F.col("drop") | (F.col("n") <= min_keep)).select("query_id", "id", F.col("n").alias("rank"))


def self_knowledge_stats(candidates: DataFrame) -> DataFrame:
    """(n_queried, n_filtered, filter_rate), rate 0 without candidates."""
    told = candidates.agg(F.count("*").alias("n_queried"), F.coalesce(F.sum((F.col("answer") == "YES").cast("long")), F.lit(0)).alias("n_filtered"))
    return told.withColumn("filter_rate", F.when(F.col("n_queried") > 0, F.col("n_filtered") / F.col("n_queried")).otherwise(0.0))


def hybrid_unknown(merged: DataFrame, responses: DataFrame, answers: DataFrame, k: int = 3, initial: int = 5, min_keep: int = 1) -> DataFrame:
    """Hybrid retrieval without what the model knows: ``initial`` reranked candidates, self-knowledge filter, the first ``k``.

    ``answers`` gives (query_id, id, answer); a pair without one is kept.
    """
    first = reranked(merged, responses, initial).join(answers.select("query_id", "id", "answer"), ["query_id", "id"], "left")
    return self_knowledge(first, min_keep).filter(F.col("rank") <= k)


def greedy_ids(response: str | F.Column) -> F.Column:
    """``selected_ids`` of the widest ``{...}`` of a response, fences dropped; empty where it is no JSON."""
    text = F.regexp_replace(F.regexp_replace(response, r"```(?:json)?\s*", ""), "```", "")
    told = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "selected_ids array<string>")["selected_ids"]
    return F.coalesce(told, F.array().cast("array<string>"))


def judged(answers: DataFrame, ids: DataFrame) -> DataFrame:
    """(ref, answer) of a judge's JSON map from references to ids; an answer that is no id is null.

    ``answers`` gives (mapping); ``ids`` (id) is the white list.
    """
    each = answers.select(F.explode(F.from_json("mapping", "map<string,string>")).alias("ref", "answer"))
    return each.join(ids.select("id", F.lit(True).alias("ok")), F.col("answer") == F.col("id"), "left").select("ref", F.when(F.col("ok"), F.col("answer")).alias("answer"))
