"""Running aggregates that no key and no table confines to one task.

A window function sorts each of its groups in one task, so a group with most
rows is one long task. Here rows are dealt by ranges of (group, order), a
window runs within each part of a group, and what a part hands on to the next
(a sum, a last value, the rows of an open time window) is carried over. Only
groups that cross a boundary between parts are carried; there are at most two
such pieces a part, so their table is no larger than twice the number of parts
and is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.sources.scratch import cut

_PART, _GHOST = "__part", "__ghost"


class Parts:
    """Rows dealt by ranges of (``by``, ``order``) and written; groups and orders may be null."""

    def __init__(self, rows: DataFrame, by: list[str], order: list[str]):
        self.by, self.order = list(by), list(order)
        self.rows = cut(rows.repartitionByRange(*self.by, *self.order).withColumn(_PART, F.spark_partition_id()), "parts")

    def running(self, **aggs: tuple[str, Column] | tuple[str, Column, Column]) -> DataFrame:
        """The rows with aggregates from the first row of their group to themselves.

        Each is (kind, column) or (kind, column, tie): sum, prod, min, max, last
        (the last value that is not null) or next (the first such from the row
        to the group's end). Rows of equal order follow ``tie``.
        """
        return self._running(aggs).drop(_PART)

    def _running(self, aggs: dict[str, tuple]) -> DataFrame:
        rows, carries, names = self.rows, [], {}
        for name, (kind, column, *tie) in aggs.items():
            rows = rows.withColumn(f"__v_{name}", column)
            names[name] = (kind, tie[0] if tie else None)
            if tie:
                rows = rows.withColumn(f"__t_{name}", tie[0])
        for name, (kind, tie) in names.items():
            v, order = F.col(f"__v_{name}"), [*map(F.col, self.order), *([F.col(f"__t_{name}")] if tie is not None else [])]
            at = F.when(v.isNotNull(), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
            carries.append({"sum": F.sum(v), "prod": F.product(v), "min": F.min(v), "max": F.max(v), "last": F.max_by(v, at), "next": F.min_by(v, at)}[kind].alias(name))
        pieces = self._crossing(rows.groupBy(*self.by, _PART).agg(*carries))
        ahead = Window.partitionBy(*self.by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
        behind = Window.partitionBy(*self.by).orderBy(_PART).rowsBetween(1, Window.unboundedFollowing)
        carried = pieces.select(*self.by, _PART, *((self._over(kind, F.col(name), behind if kind == "next" else ahead)).alias(f"__c_{name}") for name, (kind, _) in names.items()))
        out = self._with(rows, carried)
        for name, (kind, tie) in names.items():
            order = [*map(F.col, self.order), *([F.col(f"__t_{name}")] if tie is not None else [])]
            w = Window.partitionBy(_PART, *self.by).orderBy(*order)
            w = w.rowsBetween(Window.currentRow, Window.unboundedFollowing) if kind == "next" else w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            own, c = self._over(kind, F.col(f"__v_{name}"), w), F.col(f"__c_{name}")
            both = {"sum": F.when(own.isNull(), c).when(c.isNull(), own).otherwise(own + c), "prod": F.when(own.isNull(), c).when(c.isNull(), own).otherwise(c * own), "min": F.least(own, c), "max": F.greatest(own, c), "last": F.coalesce(own, c), "next": F.coalesce(own, c)}[kind]
            out = out.withColumn(name, both)
        return out.drop(*(f"__{x}_{n}" for n in names for x in "vct"))

    @staticmethod
    def _over(kind: str, v: Column, w: Window) -> Column:
        return {"sum": F.sum(v), "prod": F.product(v), "min": F.min(v), "max": F.max(v), "last": F.last(v, ignorenulls=True), "next": F.first(v, ignorenulls=True)}[kind].over(w)

    def _crossing(self, pieces: DataFrame) -> DataFrame:
        """Those of the pieces (by, part, ...) whose group has another one."""
        if not self.by:
            return pieces
        several = pieces.withColumn("__n", F.count("*").over(Window.partitionBy(*self.by)))
        return several.filter("__n > 1").drop("__n")

    def _with(self, rows: DataFrame, pieces: DataFrame) -> DataFrame:
        """Rows with what their piece carries, null for most."""
        p = pieces.select(*(F.col(k).alias(f"__k_{k}") for k in [*self.by, _PART]), *(c for c in pieces.columns if c not in [*self.by, _PART]))
        same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(p[f"__k_{k}"]) for k in [*self.by, _PART]])
        return rows.join(F.broadcast(p), same, "left").drop(*(f"__k_{k}" for k in [*self.by, _PART]))

    def rolling(self, span: int, **aggs: Column) -> DataFrame:
        """The rows with aggregates over (x - span, x] of their group, x being the one order column, of whole numbers.

        A part also gets copies of the rows before it that its windows reach.
        Windows that reach over many parts copy rows to each of them.
        """
        (x,) = self.order
        rows = self.rows.withColumn(_GHOST, F.lit(False))
        pieces = self._crossing(rows.filter(F.col(x).isNotNull()).groupBy(*self.by, _PART).agg(F.min(x).alias("__lo")))
        following = F.lead("__lo").over(Window.partitionBy(*self.by).orderBy(_PART))
        near = self._with(rows, pieces.select(*self.by, _PART, following.alias("__next"))).filter(F.col("__next") < F.col(x) + span).drop("__next")
        p = pieces.select(*(F.col(k).alias(f"__k_{k}") for k in self.by), F.col(_PART).alias("__to"), "__lo")
        reach = reduce(lambda a, b: a & b, [near[k].eqNullSafe(p[f"__k_{k}"]) for k in self.by], (F.col("__to") > F.col(_PART)) & (F.col("__lo") < F.col(x) + span))
        ghosts = near.join(F.broadcast(p), reach).withColumn(_PART, F.col("__to")).withColumn(_GHOST, F.lit(True)).select(*rows.columns)
        out = rows.unionByName(ghosts)
        w = Window.partitionBy(_PART, *self.by).orderBy(x).rangeBetween(-(span - 1), Window.currentRow)
        for name, agg in aggs.items():
            out = out.withColumn(name, agg.over(w))
        return out.filter(~F.col(_GHOST)).drop(_PART, _GHOST)

    def shifted(self, **values: tuple[int, Column]) -> DataFrame:
        """The rows with values of other rows of their group: each is (n, column), of the row ``n`` places before, or after if negative.

        The order must be unique. A part gets copies of as many rows of its
        group next to it as are asked for; where there is no such row the
        value is null.
        """
        back, ahead = max(0, *(n for n, _ in values.values())), max(0, *(-n for n, _ in values.values()))
        marked = self._running({"__at": ("sum", F.lit(1).cast("long"))})
        rows = cut(marked.select("*", *(v.alias(name) for name, (_, v) in values.items())).withColumn(_GHOST, F.lit(False)), "numbered")
        pieces = self._crossing(rows.groupBy(*self.by, _PART).agg(F.min("__at").alias("__lo"), F.max("__at").alias("__hi")))
        edges = pieces.select(*self.by, _PART, F.col("__lo").alias("__start"), F.col("__hi").alias("__end"))
        near = self._with(rows, edges).filter((F.col("__at") > F.col("__end") - back) | (F.col("__at") < F.col("__start") + ahead)).drop("__start", "__end")
        p = pieces.select(*(F.col(k).alias(f"__k_{k}") for k in self.by), F.col(_PART).alias("__to"), "__lo", "__hi")
        later, sooner = p["__to"] > near[_PART], p["__to"] < near[_PART]
        reach = (later & (near["__at"] >= p["__lo"] - back)) | (sooner & (near["__at"] <= p["__hi"] + ahead))
        ghosts = near.join(F.broadcast(p), reduce(lambda a, b: a & b, [near[k].eqNullSafe(p[f"__k_{k}"]) for k in self.by], reach))
        ghosts = ghosts.withColumn(_PART, F.col("__to")).withColumn(_GHOST, F.lit(True)).select(*rows.columns)
        w = Window.partitionBy(_PART, *self.by).orderBy("__at")
        out = rows.unionByName(ghosts).withColumns({name: F.lag(name, n).over(w) for name, (n, _) in values.items()})
        return out.filter(~F.col(_GHOST)).drop(_PART, _GHOST, "__at")


def numbered(rows: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """The rows with their number from 0 in a stated unique order, within their group or over all."""
    return Parts(rows, by or [], order).running(**{name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1)
