"""Centroid clustering: Lloyd's rounds by exponion search.

Vectors are integers and distances are exact. A vector carries its centroid,
an upper bound on the distance to it and a lower bound on the distance to any
other. After each round the bounds give way by what the centroids moved.

1. A vector whose upper bound is below its lower bound, or below half the
   distance from its centroid to the next one, keeps its centroid unseen.
2. Otherwise its own distance is taken and the test repeated.
3. What is still open scans the centroids in a ball around its own: with own
   distance u and s to the next centroid, the two nearest lie within 2u + s.
   Each centroid has a list of all others by distance, so a ball is the list's
   beginning, found by bisection. The radius is inclusive and the scan goes by
   centroid number, so ties go to the smaller one.

Bounds are widened by more than their rounding, and only strict inequalities
spare a scan: the result is that of a full search in every round.

Vectors travel as blocks of packed arrays beside their bounds. A round reads
the blocks, writes them with new bounds, and each task adds one row of sums;
the driver sees sums by centroid alone. Of the written rounds only the last is
kept. Nothing is shuffled but those sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.common import lean, pack, read_table, unpack, written

DIMS, CLUSTERS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3:"
#: Vectors of a block.
BLOCK = 4_096
#: Relative room for rounding of bounds.
ROOM = 1e-9
#: Components beyond are taken as this; distances and sums that no long holds are given as its largest.
LARGEST, LONG = 1 << 62, (1 << 63) - 1

STATE = "kind string, ids array<long>, vectors binary, bounds binary, sums array<decimal(38,0)>"


def _exact(largest: int, dims: int) -> type:
    """A number type in which squared distances of components up to ``largest`` are exact."""
    most = 4 * dims * largest * largest
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` to rows of ``c``, both of one exact type."""
    return (x * x).sum(axis=1)[:, None] - 2 * x.dot(c.T) + (c * c).sum(axis=1)[None, :]


def own_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` to the same rows of ``c``."""
    d = x - c
    return (d * d).sum(axis=1)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


@dataclass(frozen=True)
class Centroids:
    """Exact centroids of a round, what they moved since the last, and for each the others by distance."""

    rows: tuple[tuple[int, ...], ...]
    moved: tuple[float, ...] | None

    def largest(self) -> int:
        return max((abs(v) for row in self.rows for v in row), default=0)

    def array(self, kind: type) -> np.ndarray:
        return np.array(self.rows, dtype=object).astype(kind).reshape(len(self.rows), -1)

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """Others by distance (itself first) and these distances, a row a centroid."""
        exact = np.array([[sum((p - q) ** 2 for p, q in zip(a, b)) for b in self.rows] for a in self.rows], dtype=object)
        d = _root(exact)
        order = np.argsort(d, axis=1, kind="stable")
        for j, row in enumerate(order):
            # Equal centroids lie at distance 0 too; the list begins with its owner.
            at = int(np.flatnonzero(row == j)[0])
            row[: at + 1] = np.roll(row[: at + 1], 1)
        return order, np.take_along_axis(d, order, axis=1)


def search(x: np.ndarray, largest: int, centroids: Centroids, a: np.ndarray | None, u: np.ndarray | None, low: np.ndarray | None, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), upper and lower bound of each row of ``x``.

    ``a``, ``u`` and ``low`` are the last round's; None: all centroids are scanned.
    """
    k = len(centroids.rows)
    kind = _exact(max(largest, centroids.largest()), x.shape[1])
    c = centroids.array(kind)
    if a is None:
        d = distances(x.astype(kind), c)
        a = d.argmin(axis=1)
        near = np.sort(d, axis=1)[:, :2]
        _count(counts, "scanned", d.size)
        second = _root(near[:, 1]) if k > 1 else np.full(len(x), np.inf)
        return a, _root(near[:, 0]) * (1 + ROOM), second * (1 - ROOM)
    moved = np.array(centroids.moved)
    a = a.copy()
    u = (u + moved[a]) * (1 + ROOM)
    top = np.argsort(-moved, kind="stable")[:2]
    most = np.full(k, moved[top[0]])
    if k > 1:
        most[top[0]] = moved[top[1]]
    low = (low - most[a]) * (1 - ROOM) - ROOM * most[a]
    order, away = centroids.lists()
    half = away[:, 1] / 2 * (1 - ROOM) if k > 1 else np.full(k, np.inf)
    at = np.flatnonzero(u >= np.maximum(low, half[a]))
    if len(at):
        _count(counts, "own", len(at))
        u[at] = _root(own_distances(x[at].astype(kind), c[a[at]])) * (1 + ROOM)
        at = at[u[at] >= np.maximum(low[at], half[a[at]])]
    if not len(at):
        return a, u, low
    # Balls: the centroid's list up to 2u + s, inclusive.
    radius = (2 * u[at] + away[a[at], 1]) * (1 + ROOM)
    size = np.empty(len(at), np.int64)
    for j in np.unique(a[at]):
        of = np.flatnonzero(a[at] == j)
        size[of] = np.searchsorted(away[j], radius[of], "right")
    group = a[at] * (k + 1) + size
    by = np.argsort(group, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
        j, n = int(a[at[part[0]]]), int(size[part[0]])
        ball = np.sort(order[j, :n])
        _count(counts, "scanned", len(part) * n)
        rows = at[part]
        d = distances(x[rows].astype(kind), c[ball])
        first = d.argmin(axis=1)
        near = np.sort(d, axis=1)[:, :2]
        a[rows] = ball[first]
        u[rows] = _root(near[:, 0]) * (1 + ROOM)
        low[rows] = _root(near[:, 1]) * (1 - ROOM)
    return a, u, low


def _count(counts: dict | None, name: str, n: int) -> None:
    if counts is not None:
        counts[name] = counts.get(name, 0) + n


def _small(values: np.ndarray) -> np.ndarray:
    """``values`` in the smallest integer type that holds them."""
    largest = int(np.abs(values).max(initial=0))
    return values.astype(np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64)


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), at most ``LARGEST`` in size."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * scale)
    return np.clip(scaled, -float(LARGEST), float(LARGEST)).astype(np.int64)


def _is_vector(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null, NaN or infinite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    return (F.size(vector) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


_STATE_SCHEMA = pa.schema([("kind", pa.string()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("bounds", pa.binary()), ("sums", pa.list_(pa.decimal128(38, 0)))])


def _state_row(kind: str | None, ids: pa.Array | None, vectors: bytes | None, bounds: bytes | None, sums: list[int] | None) -> pa.RecordBatch:
    """One block, or one task's sums."""
    listed = pa.array([None], pa.list_(pa.int64())) if ids is None else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    summed = pa.array([None if sums is None else [Decimal(v) for v in sums]], pa.list_(pa.decimal128(38, 0)))
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.string()), listed, pa.array([vectors], pa.binary()), pa.array([bounds], pa.binary()), summed], schema=_STATE_SCHEMA)


class _Sums:
    """Per centroid: number of vectors, squared distances, components."""

    def __init__(self, k: int, dims: int):
        self.k, self.dims = k, dims
        self.total = np.zeros((k, 2 + dims), dtype=object)

    def add(self, x: np.ndarray, largest: int, a: np.ndarray, squared: np.ndarray | None) -> None:
        wide = object if largest * max(len(x), 1) >= 1 << 63 else np.int64
        for j in np.unique(a):
            of = a == j
            self.total[j, 0] += int(of.sum())
            if squared is not None:
                self.total[j, 1] += sum(squared[of].tolist())
            self.total[j, 2:] += x[of].astype(wide).sum(axis=0).astype(object)

    def flat(self) -> list[int]:
        return [int(v) for v in self.total.ravel()]


def _blocks_of(key: str, scale: int, dims: int, centroids: Centroids, block: int) -> Callable:
    """First round: vectors become blocks, each searched in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(len(centroids.rows), dims)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                x = _integers(values, scale)
                yield _searched(part.column(0), x, centroids, None, None, None, sums, False)
        yield _state_row(None, None, None, None, sums.flat())

    return lean(run)


def _searched(ids: pa.Array, x: np.ndarray, centroids: Centroids, a, u, low, sums: _Sums, last: bool) -> pa.RecordBatch:
    largest = int(np.abs(x).max(initial=0))
    a, u, low = search(x, largest, centroids, a, u, low)
    squared = None
    if last:
        kind = _exact(max(largest, centroids.largest()), x.shape[1])
        squared = own_distances(x.astype(kind), centroids.array(kind)[a])
        squared = np.array([int(v) for v in squared], dtype=object)
    sums.add(x, largest, a, squared)
    small = _small(x)
    if last:
        bounds = pack(a.astype(np.int32), np.array([min(v, LONG) for v in squared], np.int64))
    else:
        bounds = pack(a.astype(np.int32), u.astype(np.float64), low.astype(np.float64))
    return _state_row(small.dtype.str, ids, None if last else pack(small.ravel()), bounds, None)


def _next_round(dims: int, centroids: Centroids, last: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(len(centroids.rows), dims)
        for batch in batches:
            for r in range(batch.num_rows):
                kind, ids, vectors, bounds = (batch.column(i)[r] for i in range(4))
                x = unpack(vectors.as_py(), np.dtype(kind.as_py()))[0].reshape(-1, dims).astype(np.int64)
                a, u, low = unpack(bounds.as_py(), np.int32, np.float64, np.float64)
                yield _searched(ids.values, x, centroids, a.astype(np.int64), u, low, sums, last)
        yield _state_row(None, None, None, None, sums.flat())

    return lean(run)


def _totals(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """All tasks' sums, a row a centroid: count, squared distances, components."""
    rows = state.filter(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k * (2 + dims), dtype=object)
    for r in rows:
        out[r["at"]] = int(r["v"])
    return out.reshape(k, 2 + dims)


def _moved_to(totals: np.ndarray, before: Centroids) -> Centroids:
    """Floors of the means; an empty centroid stays."""
    rows = tuple(tuple(int(v) // int(t[0]) for v in t[2:]) if t[0] else old for t, old in zip(totals, before.rows))
    moved = tuple(float(_root(np.array(sum((p - q) ** 2 for p, q in zip(a, b)), dtype=object).reshape(1))[0]) * (1 + ROOM) for a, b in zip(rows, before.rows))
    return Centroids(rows, moved)


def first_centroids(vectors: DataFrame, key: str, vector: str, k: int, salt: str, scale: int) -> tuple[tuple[int, ...], ...]:
    """The ``k`` vectors with the smallest hashes of salt and id, in their order; equal ids by components."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"), 256).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    return tuple(tuple(int(c) for c in _integers(np.array(r["v"]), scale)) for r in hashed.orderBy("h", "v").limit(k).collect())


def cluster(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    dims: int = DIMS,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    salt: str = SALT,
    block: int = BLOCK,
) -> DataFrame:
    """One row a kept vector: its key, cluster, squared distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null, NaN or
    infinite; null vectors are not. Null keys and repeated rows stay, each on
    its own (a null key is hashed as ``null``); other columns are ignored. With
    fewer than ``k`` kept vectors there are as many centroids; an empty table
    gives no rows. Components that ``scale`` takes beyond 2^62 count as 2^62;
    distances and inertia beyond a long are given as its largest value.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).filter(_is_vector(F.col("vector"), dims))
    first = first_centroids(kept, "key", "vector", k, salt, scale)
    out = f"`{key}` long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    now = Centroids(first, None)
    state, drop = written(kept.mapInArrow(_blocks_of(key, scale, dims, now, block), STATE))
    totals = _totals(state, len(first), dims)
    for r in range(1, rounds + 1):
        now = _moved_to(totals, now)
        blocks = state.filter(F.col("vectors").isNotNull()).select("kind", "ids", "vectors", "bounds")
        before = drop
        state, drop = written(blocks.mapInArrow(_next_round(dims, now, r == rounds), STATE))
        totals = _totals(state, len(first), dims)
        before()
    # Totals of the last search go by the last centroids.
    inertia = [int(t[1]) for t in totals]
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in now.rows]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, bounds in zip(batch.column(0), batch.column(1)):
                a, squared = unpack(bounds.as_py(), np.int32, np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(a, pa.int32()), pa.array(squared)], names=[key, "cluster", "distance"])

    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    long = lambda v: F.lit(min(v, LONG)).cast("long")
    found = state.filter(F.col("ids").isNotNull()).select("ids", "bounds").mapInArrow(told, out)
    return found.select(
        key, "cluster", "distance", of([long(v) for v in inertia]).alias("cluster_inertia"), long(sum(inertia)).alias("inertia"), of(digests).alias("centroid_sha256")
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, ten rounds over eight centroids."""
    return cluster(read_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same rounds as SQL: vectors and centroids as one row a component."""
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {DIMS}
), parts AS MATERIALIZED (
  SELECT vec_id, unnest(v) AS x, unnest(range({DIMS})) AS i FROM kept
), seeds AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{SALT}' || vec_id)) - 1 AS c FROM kept ORDER BY sha256('{SALT}' || vec_id) LIMIT {CLUSTERS}
), c0 AS MATERIALIZED (
  SELECT c, i, x FROM seeds JOIN parts USING (vec_id)
)"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, c, d FROM (SELECT p.vec_id, k.c, sum((p.x - k.x) * (p.x - k.x))::BIGINT AS d FROM parts p JOIN c{r} k USING (i) GROUP BY p.vec_id, k.c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1
)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM c{r} k
  LEFT JOIN (SELECT c, i, {floor} AS x FROM (SELECT a.c, p.i, sum(p.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN parts p USING (vec_id) GROUP BY a.c, p.i)) m USING (c, i)
)""")
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, k.digest AS centroid_sha256
FROM a{ROUNDS} a JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS digest FROM c{ROUNDS} GROUP BY c) k USING (c)
"""


OP11_SQL = _sql()
