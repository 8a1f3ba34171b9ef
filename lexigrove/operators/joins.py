"""Equi-joins whose keys are uneven: heavy keys are counted, cut into parts, and met by copies of the other side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.sources.scratch import cut

#: A key with more than this part of a side's rows is heavy; so there are fewer heavy keys than this.
HEAVY = 1_000
#: Values in a list that stands for rows, about at most: a pair of lists is unfolded at once, so this bounds what a task holds. Cells of a product of lists that a task gets, about.
LIST, CELLS = 256, 4


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys to as many tasks as shuffles have, whatever files they lie in.

    For steps whose rows are short and whose work a row is not: a file of short
    rows is a task or two, and adaptive execution merges small partitions
    unless their number is given.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def skew_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, heavy: int = HEAVY) -> DataFrame:
    """Inner join of ``left``, whose keys may be heavy, with ``right``; other column names must differ.

    A key that holds more than ``1 / heavy`` of the rows of ``left`` is cut into as many
    parts as it holds such shares, dealt by a hash of the whole row; rows of
    ``right`` with that key are copied to each part. Keys are counted with
    partial sums, and the table of heavy ones, fewer than ``heavy`` rows, is
    broadcast. Null keys meet nothing. Repeated rows of ``left`` share a part.
    """
    right_on = right_on or left_on
    keys = [f"__key_{i}" for i in range(len(left_on))]
    big = left.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in left_on])).withColumns(dict(zip(keys, map(F.col, left_on))))
    small = right.select(*(F.col(c).alias(k) for c, k in zip(right_on, keys, strict=True)), *(c for c in right.columns if c not in left_on or c not in right_on))
    counts = big.groupBy(*keys).agg(F.count("*").alias("__n"))
    shares = counts.join(F.broadcast(counts.agg(F.sum("__n").alias("__all")))).withColumn("__parts", F.ceil(F.col("__n") * heavy / F.col("__all")).cast("int"))
    hot = cut(shares.filter("__parts > 1").select(*keys, "__parts"), "heavy")
    dealt = big.withColumn("__deal", F.xxhash64(*left.columns)).join(F.broadcast(hot), keys, "left")
    dealt = dealt.withColumn("__part", F.pmod("__deal", F.coalesce("__parts", F.lit(1))).cast("int")).drop("__deal", "__parts")
    copied = small.join(F.broadcast(hot), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copied, [*keys, "__part"]).drop(*keys, "__part")


def product_of_lists(left: DataFrame, right: DataFrame, key: str, left_list: str, right_value: str) -> DataFrame:
    """Inner join of ``left`` (key, others, a list) with ``right`` (key, a value): a row a value and item of the list.

    For joins whose rows are far more than both sides: neither is repeated row by row before the last step. Values of
    ``right`` are gathered in lists, and the rows of a key are cut into a grid of cells, as many as are its share of all rows, so
    that equal parts of them are dealt to all tasks; lists are unfolded there, one item after the other, and not
    shuffled, sorted or held. The items keep the list's name.
    """
    sizes = left.groupBy(key).agg(F.sum(F.size(left_list)).alias("__l")).join(right.groupBy(key).agg(F.count("*").alias("__r")), key)
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    product = F.col("__l").cast("double") * F.col("__r")
    sizes = cut(sizes.filter("__l > 0").withColumn("__product", product), "sizes")
    cells = F.ceil(F.lit(CELLS * tasks) * F.col("__product") / F.col("__all"))
    grid = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("__product").alias("__all")))).withColumn("__cells", cells)
    # As many cuts of each side as copy the fewest values of both.
    grid = grid.withColumn("__a", F.least("__cells", F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("__cells") * F.col("__l") / F.col("__r"))))).cast("int"))
    grid = grid.withColumn("__b", F.ceil(F.col("__cells") / F.col("__a")).cast("int")).select(key, "__a", "__b", "__r")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [c for c in left.columns if c not in (key, left_list)]
    one = left.join(grid, key).withColumn("__i", F.pmod(F.xxhash64(*left.columns), "__a").cast("int")).withColumn("__j", every("__b"))
    listed = F.pmod(F.xxhash64(right_value), F.col("__b") * F.ceil(F.col("__r") / F.col("__b") / LIST))
    two = right.join(grid, key).groupBy(key, "__a", "__b", listed.alias("__at")).agg(F.collect_list(right_value).alias("__values"))
    two = two.select(key, F.pmod("__at", "__b").cast("int").alias("__j"), "__values", every("__a").alias("__i"))
    # Numbers of partitions are given: by their bytes they would be merged, but what they unfold to is the work.
    dealt_to = [tasks, key, "__i", "__j"]
    met = one.select(key, *columns, left_list, "__i", "__j").repartition(*dealt_to).join(two.repartition(*dealt_to).hint("merge"), [key, "__i", "__j"])
    # Values are the inner loop: a key's items may be spread over many short lists, its values are not.
    return met.select(*columns, "__values", F.explode(left_list).alias(left_list)).select(F.explode("__values").alias(right_value), *columns, left_list)
