"""Relational verbs with the strictness that a DataFrame leaves out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrove.operators.joins import skew_join
from lexigrove.operators.scans import Parts, numbered


class NotUnique(ValueError):
    """A join key or pivot cell has more than one row."""


class SchemaMismatch(ValueError):
    """Frames to be stacked have different schemas."""


def _assert_unique(df: DataFrame, keys: list[str], side: str) -> None:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise NotUnique(f"the {side} side has repeated keys {keys}")


def join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, how: str = "inner", validate: str = "m:m", suffix: str = "_right") -> DataFrame:
    """Join on named keys; the right side's other columns get a suffix where names collide.

    ``validate`` (1:1, 1:m, m:1, m:m) checks which sides' keys are unique.
    Semi and anti joins return left columns only; a cross join takes no keys.
    """
    right_on = right_on or left_on
    one_left, one_right = (x == "1" for x in validate.split(":"))
    if one_left:
        _assert_unique(left, left_on, "left")
    if one_right:
        _assert_unique(right, right_on, "right")
    names = set(left.columns)
    keys = [f"__key_{i}" for i in range(len(right_on))]
    held = right.select(*(F.col(c).alias(k) for c, k in zip(right_on, keys, strict=True)), *(F.col(c).alias(c + suffix if c in names else c) for c in right.columns if c not in right_on))
    condition = reduce(lambda a, b: a & b, [left[a] == held[k] for a, k in zip(left_on, keys, strict=True)])
    joined = left.join(held, condition, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    if how == "full":
        for a, k in zip(left_on, keys, strict=True):
            joined = joined.withColumn(a, F.coalesce(a, k))
    return joined if how in ("semi", "anti") else joined.drop(*keys)


def supertype(kinds: list[T.DataType]) -> T.DataType:
    """The type that all given ones widen to; text if a string is among different ones."""
    kinds = [k for k in dict.fromkeys(kinds) if not isinstance(k, T.NullType)] or [T.NullType()]
    if len(kinds) == 1:
        return kinds[0]
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return max(kinds, key=lambda k: [T.ByteType, T.ShortType, T.IntegerType, T.LongType].index(type(k)))
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.DoubleType()
    if any(isinstance(k, T.StringType) for k in kinds):
        return T.StringType()
    raise SchemaMismatch(f"no common type of {kinds}")


def concat(frames: list[DataFrame], how: str = "vertical") -> DataFrame:
    """Stack frames.

    vertical: schemas must be equal; vertical_relaxed: same columns, types
    widen; diagonal_relaxed: missing columns are null, types widen.
    """
    if how == "vertical":
        if any(f.dtypes != frames[0].dtypes for f in frames):
            raise SchemaMismatch("schemas differ; use a relaxed way")
        return reduce(DataFrame.union, frames)
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    if how == "vertical_relaxed" and any(f.columns != frames[0].columns for f in frames):
        raise SchemaMismatch("columns differ; use diagonal_relaxed")
    kinds = {c: supertype([f.schema[c].dataType for f in frames if c in f.columns]) for c in names}
    return reduce(DataFrame.union, [f.select(*((F.col(c) if c in f.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names)) for f in frames])


def concat_horizontal(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Put frames side by side by the place of their rows in given unique orders; the shorter one is filled with null."""
    return numbered(left, [left_order], "__n").join(numbered(right, [right_order], "__n"), "__n", "full").drop("__n")


def pivot(df: DataFrame, index: str, on: str, values: str, columns: list[str]) -> DataFrame:
    """One row an index value and one column a value of ``on``; repeated cells are an error."""
    _assert_unique(df, [index, on], "pivot")
    return df.groupBy(index).pivot(on, columns).agg(F.first(values))


def over(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """The rows with aggregates of their group, which are made first and joined back; a null key is a group.

    A group may hold any part of the rows.
    """
    groups = df.groupBy(*by).agg(*(a.alias(n) for n, a in aggs.items())).select(F.struct(*by).alias("__by"), *aggs)
    return skew_join(df.withColumn("__by", F.struct(*by)), groups, ["__by"]).drop("__by")


def average_rank(df: DataFrame, x: str, by: list[str], name: str) -> DataFrame:
    """Rank from 1 within groups (null first), ties get the mean of their places.

    Only the distinct values of a group are put in order.
    """
    values = df.groupBy(*by, x).agg(F.count("*").alias("__n"))
    ranks = Parts(values, by, [x]).running(__to=("sum", F.col("__n")))
    ranks = ranks.select(F.struct(*by, x).alias("__by"), (F.col("__to") - (F.col("__n") - 1) / 2.0).alias(name))
    return skew_join(df.withColumn("__by", F.struct(*by, x)), ranks, ["__by"]).drop("__by")


def cum_prod(df: DataFrame, x: str, by: list[str], order: list[str], name: str) -> DataFrame:
    """Cumulative product in a stated unique order; nulls count as 1."""
    return Parts(df, by, order).running(**{name: ("prod", F.coalesce(F.col(x).cast("double"), F.lit(1.0)))})


def shift(df: DataFrame, by: list[str], order: list[str], **columns: tuple[int, str]) -> DataFrame:
    """Columns of other rows, in a stated unique order: (n, column) by new name, ``n`` places before or, if negative, after."""
    return Parts(df, by, order).shifted(**{name: (n, F.col(c)) for name, (n, c) in columns.items()})


def diff(df: DataFrame, x: str, by: list[str], order: list[str], name: str, n: int = 1) -> DataFrame:
    """The difference to the row ``n`` places before."""
    return shift(df, by, order, **{name: (n, x)}).withColumn(name, F.col(x) - F.col(name))


def replace_first(text: Column, old: str, new: str) -> Column:
    """Replace the first literal occurrence."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(new), F.substr(text, at + F.lit(len(old))))).otherwise(text)


def categories(df: DataFrame, column: str, code: str) -> DataFrame:
    """A dense integer code for each distinct text, by order of the text; null stays null.

    The code comes from the distinct values alone and is joined back.
    """
    seen = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return df.join(numbered(seen, [column], code).withColumn(code, F.col(code).cast("int")), column, "left")
