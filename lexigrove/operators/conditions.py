"""The six retrieval conditions of an ablation, each as one (query_id, id, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.operators import bm25, fusion
from lexigrove.sources.scratch import cut

NAMES = ("null", "hybrid", "bm25", "flat_selection", "tree_selection", "irrelevant")


def all_conditions(index: bm25.Index, queries: DataFrame, flat: DataFrame, by_tree: DataFrame, rerank: DataFrame, k: int = 3, wide: int = 8, narrow: int = 5) -> dict[str, DataFrame]:
    """Retrieval under each of :data:`NAMES`.

    ``queries`` gives (query_id, text); ``flat`` and ``by_tree`` (query_id,
    ids) hold a model's selections over the listing and over the tree, and
    ``rerank`` its order of the merged candidates. Ids that are no nodes are
    dropped after the cut to ``k``.
    """
    nodes = index.lengths.select(F.col("id").cast("string").alias("id"))

    def chosen(responses: DataFrame, n: int) -> DataFrame:
        each = responses.select("query_id", F.posexplode(F.slice("ids", 1, n)).alias("pos", "id"))
        return each.join(nodes, "id", "left_semi").select("query_id", "id", (F.col("pos") + 1).alias("rank"))

    text = lambda df: df.select("query_id", F.col("id").cast("string").alias("id"), "rank")
    # Two conditions order the same scores: they are written once.
    scored = cut(bm25.scores(index, queries), "scores")
    lists = text(bm25.top_k(scored, wide)).withColumn("list_no", F.lit(0)).unionByName(chosen(by_tree, narrow).withColumn("list_no", F.lit(1)))
    merged = fusion.rrf(lists, wide)
    return {
        "null": text(bm25.retrieve_nothing(queries)), "hybrid": fusion.reranked(merged, rerank, k), "bm25": text(bm25.top_k(scored, k)),
        "flat_selection": chosen(flat, k), "tree_selection": chosen(by_tree, k), "irrelevant": text(bm25.least_relevant(index, queries, k)),
    }
