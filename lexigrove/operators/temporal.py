"""Time semantics: dynamic groups, rolling windows, as-of joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.operators.scans import Parts

#: Duration units and the interval words they stand for.
UNITS = {
    "ns": None, "us": "microsecond", "ms": "millisecond", "s": "second", "m": "minute", "h": "hour", "d": "day",
    "w": "week", "mo": "month", "q": "quarter", "y": "year",
}
_MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def parse_duration(text: str) -> list[tuple[int, str]]:
    """``1d12h`` to [(1, 'd'), (12, 'h')]; a leading minus negates all."""
    sign, rest = (-1, text[1:]) if text.startswith("-") else (1, text)
    parts = re.findall(r"(\d+)(ns|us|ms|mo|[smhdwqy])", rest)
    if not parts or "".join(a + b for a, b in parts) != rest:
        raise ValueError(f"not a duration: {text!r}")
    return [(sign * int(n), unit) for n, unit in parts]


def micros(text: str) -> int:
    """Microseconds of a duration without months, quarters or years."""
    total = 0
    for n, unit in parse_duration(text):
        if unit == "ns":
            total += n // 1000
        elif unit in _MICROS:
            total += n * _MICROS[unit]
        else:
            raise ValueError(f"{text!r} has no fixed length")
    return total


def offset_by(ts: Column, duration: str) -> Column:
    """Shift by a duration; months, quarters and years follow the calendar."""
    for n, unit in parse_duration(duration):
        if unit in ("mo", "q", "y"):
            months = n * {"mo": 1, "q": 3, "y": 12}[unit]
            ts = ts + F.make_ym_interval(F.lit(0), F.lit(months))
        elif unit == "ns":
            ts = ts + F.make_dt_interval(secs=F.lit(n / 1e9))
        else:
            ts = ts + F.make_dt_interval(secs=F.lit(n * _MICROS[unit] / 1e6))
    return ts


def truncate(ts: Column, unit: str) -> Column:
    """Start of the unit (``1d``, ``1mo``, ...) that a timestamp without zone lies in."""
    (n, u), *more = parse_duration(unit)
    if more or n != 1 or UNITS[u] is None:
        raise ValueError("one unit only")
    return F.date_trunc(UNITS[u], ts).cast("timestamp_ntz")


def _us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _ntz(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def window_starts(ts: Column, every: str, period: str | None = None, offset: str = "0s", closed: str = "left") -> Column:
    """Array of the starts of all windows [start, start + period) that hold a time.

    Windows start at multiples of ``every`` since 1970-01-01, plus the offset.
    ``closed``: which ends count, left, right, both or none.
    """
    e, p, o = micros(every), micros(period or every), micros(offset)
    t = _us(ts) - o
    # A window with start s holds t if s <= t < s + p, with the ends as closed says.
    low = t - p + (1 if closed in ("left", "none") else 0)
    high = t - (1 if closed in ("right", "none") else 0)
    first, last = F.ceil(low / F.lit(e)).cast("long"), F.floor(high / F.lit(e)).cast("long")
    exact_first = -F.floor((-low) / F.lit(e)).cast("long")
    starts = F.when(last >= exact_first, F.sequence(exact_first, last)).otherwise(F.array().cast("array<bigint>"))
    del first
    return F.transform(starts, lambda k: _ntz(k * F.lit(e) + F.lit(o)))


def group_by_dynamic(rows: DataFrame, ts: str, aggs: list[Column], every: str, period: str | None = None, offset: str = "0s", closed: str = "left", by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregate over windows of time: (by..., window_start, aggregates). A row counts in each window that holds it."""
    starts = window_starts(F.col(ts), every, period, offset, closed)
    return rows.withColumn("window_start", F.explode(starts)).groupBy(*by, "window_start").agg(*aggs)


def rolling(rows: DataFrame, ts: str, period: str, aggs: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """One result a row over (t - period, t]. ``aggs`` maps names to aggregate columns; a group of any size is spread over the tasks."""
    parts = Parts(rows.withColumn("__us", _us(F.col(ts))), list(by), ["__us"])
    return parts.rolling(micros(period), **aggs).drop("__us")


def join_asof(left: DataFrame, right: DataFrame, on: str, by: str, value: list[str], strategy: str = "backward", tolerance: str | None = None, suffix: str = "_right") -> DataFrame:
    """Left rows with the values of the nearest right row of the same ``by``.

    backward: last right time that is not later; forward: first that is not
    earlier; nearest: the closer of both, backward on ties. Beyond the
    tolerance, and without a partner, values are null. Both sides are merged
    into sorted runs, of which a large key has several that hand on their last
    value, so nothing is joined on ranges.
    """
    hit = F.struct(F.col(on).alias("at"), *(F.col(v) for v in value))
    marked = left.select(F.col(by), F.col(on), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(hit).schema[0].dataType).alias("__hit"))
    found = right.select(F.col(by), F.col(on), F.lit(0).alias("__side"), F.lit(None).cast(marked.schema["__row"].dataType).alias("__row"), hit.alias("__hit"))
    both = marked.unionByName(found)
    if strategy not in ("backward", "forward", "nearest"):
        raise ValueError(f"no strategy {strategy!r}")
    # At equal times right rows stand before left ones for a look back, after them for a look ahead.
    back, ahead = ("last", F.col("__hit"), F.col("__side")), ("next", F.col("__hit"), -F.col("__side"))
    sought = {"backward": {"__best": back}, "forward": {"__best": ahead}, "nearest": {"__b": back, "__f": ahead}}[strategy]
    both = Parts(both, [by], [on]).running(**sought)
    if strategy == "nearest":
        near = (_us(F.col(on)) - _us(F.col("__b.at"))) <= (_us(F.col("__f.at")) - _us(F.col(on)))
        both = both.withColumn("__best", F.when(F.col("__f").isNull() | near, F.col("__b")).otherwise(F.col("__f")))
    if tolerance is not None:
        far = F.abs(_us(F.col(on)) - _us(F.col("__best.at"))) > F.lit(micros(tolerance))
        both = both.withColumn("__best", F.when(~far, F.col("__best")))
    names = set(left.columns)
    return both.filter("__side = 1").select("__row.*", *(F.col(f"__best.{v}").alias(v + suffix if v in names else v) for v in value))
