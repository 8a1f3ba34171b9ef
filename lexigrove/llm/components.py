"""Connected components of a graph given by its edges.

Rounds of min-neighbour contraction: every vertex and its neighbours are tied
to the smallest of them. Chains shrink by a factor each round, so the rounds
grow with the logarithm of the longest chain; each round is written to the
shared folder. Edges of one vertex are never gathered: minima are combined
before the shuffle, and adaptive execution splits joins on a vertex with many
edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import materialize

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (id, root): the smallest id that each vertex reaches.

    Loops, repeated and reversed edges are fine; edges with a null end are
    ignored; vertices without edges are not listed.
    """
    # Every edge points from the larger id to a smaller one.
    pairs = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        # Large star: every larger neighbour of a vertex is tied to the vertex's smallest neighbour (or itself).
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        up = pairs.join(low, pairs["b"] == low["v"], "left").select("a", F.coalesce("m", "b").alias("b"))
        # Small star: smaller neighbours and the vertex itself are tied to the smallest.
        own = up.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        joined = up.join(own, up["a"] == own["v"])
        tied = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = materialize(tied.filter("a <> b").distinct())
        pairs = new
        # Settled if every vertex points once, to one that points nowhere.
        ends = new.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("e.*")
        told = ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if not told.agg(F.count_if((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") > 0))).first()[0]:
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
