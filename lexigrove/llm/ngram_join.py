"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its distinct n-word shingles; two link if their
Jaccard similarity reaches a threshold p/q. The result is each document's
component: the smallest id that links reach.

Within a batch of documents the count vectors (shingles per hash group) are
points of a packed R-tree. It is joined with itself: the summed minima of a
point and a box's upper corner bound the shingles in common, the summed minima
of finer vectors bound them again, and pairs that are left are verified on
their sets. The result is exact for all pairs of the batch.

Batches are brought together by keys, which route and decide nothing. If there
are more groups than two linked sets can differ in
(``|A|+|B|`` times ``(q-p)/(q+p)``), some group is the same in both. Sizes fall
into bands (partners lie in the same or the next one), each band has its number
of groups, and a key is a hash of (band, group, content). Sets with so many
empty groups that only empty ones might agree add keys of the classic prefix
filter. So every linked pair shares a key; no partner is capped. Documents that
share a key are compared with the first of them.

Members of what keys connect and links do not are open. Chance keys join more
and more documents as a corpus grows, and at last most of it is one component,
so components are not compared as a whole: members meet under the keys that
they share, as sketches (count vectors, whose summed minima bound what is in
common), and the pairs that these leave are verified. Keys of the same members
count once, and the rule is the same at any size of a component, so these rows
grow as the corpus does. Only where members share so many keys that this moves
more than their texts is a component searched in R-trees again: as one task,
or, if it is large, cut by set size and into blocks, whose pairs are tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.common import CHUNK_BYTES, Text, bucket_count, chunks, join_salted, lean, lowered, materialize, mix, pack, read_table, sequences, unpack
from lexigrove.llm.components import components

#: Coordinates of a count vector, and least and most of the finer one that is looked at before a set is; powers of two.
DIMENSIONS, FINE, MOST_FINE = 64, 512, 4_096
#: Text bytes that are dealt together, and members of a block of a large component.
BATCH_BYTES = 4_000_000
BLOCK = 3_000
#: Shingles that count as one more member of a block.
HEAVY = 1_000
#: Sketches under keys that cost as much as a text in a block, about.
KEY_ROWS = 10


@dataclass(frozen=True)
class Threshold:
    """Sets link if ``q * |A & B| >= p * |A | B|``."""

    p: int
    q: int

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.q * common >= self.p * (a + b - common)

    def needed(self, a, b):
        """Common shingles that a linked pair of these sizes has at least (a real number)."""
        return (a + b) * (self.p / (self.p + self.q)) - 1e-6

    def bands(self, largest: int) -> np.ndarray:
        """First size of each band, up to the one after that of ``largest``."""
        out = [1]
        while out[-1] <= largest:
            out.append(self.q * out[-1] // self.p + 1)
        return np.array([*out, self.q * out[-1] // self.p + 1], np.int64)

    def groups(self, band: int, bands: np.ndarray) -> tuple[int, int]:
        """(groups, most that can differ) for pairs whose larger set is in ``band``."""
        differ = 2 * int(bands[band + 1] - 1) * (self.q - self.p) // (self.q + self.p)
        return differ + 1 + max(1, (differ + 1) // 10), differ


def shingle_sets(text: Text, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk.

    Texts with fewer than ``n`` words have their whole word sequence as the one
    shingle; without words the set is empty.
    """
    start, end, row = text.words()
    units = text.hashes(start, end, lowered(text.data)) if len(start) else np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=text.n)
    head = np.concatenate(([0], np.cumsum(count)))
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * text.n
    full = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
    made = sequences(units, full, n)
    cut = np.searchsorted(full, head)
    for i in range(text.n):
        if count[i] >= n:
            out[i] = np.unique(made[cut[i] : cut[i + 1]])
        elif count[i]:
            out[i] = sequences(units, head[i : i + 1], int(count[i]))
    return out


def count_vector(shingles: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    shift = np.uint64(64 - (dimensions - 1).bit_length())
    return np.bincount((shingles >> shift).astype(np.int64), minlength=dimensions)


def count_vectors(sets: list[np.ndarray], dimensions: int) -> np.ndarray:
    """Vectors of several sets, in the narrowest type that holds their counts."""
    made = np.zeros((len(sets), dimensions), np.uint8)
    for i, s in enumerate(sets):
        v = count_vector(s, dimensions)
        if made.dtype == np.uint8 and v.max(initial=0) > 255:
            made = made.astype(np.int32)
        made[i] = v
    return made


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def links(a: np.ndarray, b: np.ndarray, t: Threshold) -> bool:
    """Exact test, after the bound by summed minima of the count vectors."""
    if not len(a) or not len(b):
        return False
    if np.minimum(count_vector(a), count_vector(b)).sum() < t.needed(len(a), len(b)):
        return False
    return t.linked(common_size(a, b), len(a), len(b))


def keys_of(sets: list[np.ndarray], t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of its set) of all dealing keys of the sets."""
    size = np.array([len(s) for s in sets], np.int64)
    bands = t.bands(int(size.max(initial=1)))
    own = np.searchsorted(bands, size, "right") - 1
    keys, owners = [], []
    everything = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    head = np.concatenate(([0], np.cumsum(size)))
    low, high = (everything & np.uint64(0xFFFFFFFF)).astype(np.float64), (everything >> np.uint64(32)).astype(np.float64)
    folded = (everything >> np.uint64(7)).astype(np.uint64)
    for band in np.unique(np.concatenate((own, own + 1))):
        mine = np.flatnonzero(((own == band) | (own == band - 1)) & (size > 0))
        if not len(mine):
            continue
        m, differ = t.groups(int(band), bands)
        local = np.repeat(np.arange(len(mine)), size[mine])
        at = np.concatenate([np.arange(head[i], head[i + 1]) for i in mine])
        cell = local * m + (mix(folded[at] + np.uint64(int(band))) % np.uint64(m)).astype(np.int64)
        total = len(mine) * m
        # Sums of 32-bit halves are exact in doubles and do not depend on order.
        n_in = np.bincount(cell, minlength=total)
        a = np.bincount(cell, weights=low[at], minlength=total).astype(np.uint64)
        b = np.bincount(cell, weights=high[at], minlength=total).astype(np.uint64)
        group = np.tile(np.arange(m, dtype=np.uint64), len(mine))
        key = mix(mix(a + (group << np.uint64(40))) + mix(b ^ np.uint64(0x5851F42D4C957F2D)) + n_in.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(int(band)))
        full = n_in > 0
        keys.append(key[full])
        owners.append(np.repeat(mine, m)[full])
        empty = m - full.reshape(len(mine), m).sum(axis=1)
        for i in mine[empty >= m - differ]:
            prefix = len(sets[i]) - -(-t.p * len(sets[i]) // t.q) + 1
            keys.append(mix(sets[i][:prefix] ^ np.uint64(0xD1B54A32D192ED03 + int(band))))
            owners.append(np.full(prefix, i))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tie equal keys to their smallest node: (first index of each key, pairs' low ends, high ends)."""
    order = np.lexsort((node, key))
    k, v = key[order], node[order]
    head = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    low = v[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(k) else v
    apart = low != v
    if not apart.any():
        return order[head], v[:0], v[:0]
    pairs = np.unique(np.stack((low[apart], v[apart]), axis=1), axis=0)
    return order[head], pairs[:, 0], pairs[:, 1]


def groups_of(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, node) rows of the keys of three nodes or more, each set of nodes once.

    A group is named by a hash of its nodes, so keys that the same documents
    share are one group, also where they are dealt to different buckets.
    """
    order = np.lexsort((node, key))
    k, v = key[order], node[order]
    new = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])) if len(k) else np.zeros(0, bool)
    k, v = k[new], v[new]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(k)))
    name = mix(np.add.reduceat(mix(v.astype(np.uint64)), head) + count.astype(np.uint64)) if len(k) else k
    # Of keys of the same name the first one stays.
    first = np.zeros(len(head), bool)
    first[np.unique(name, return_index=True)[1]] = True
    kept = np.repeat(first & (count > 2), count)
    return np.repeat(name, count)[kept], v[kept]


class CountTree:
    """Packed R-tree over count vectors; boxes keep their upper corner and smallest size."""

    FAN = 32

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        spread = vectors.var(axis=0)
        widest = np.argsort(-spread)[:2]
        slices = np.argsort(np.argsort(sizes, kind="stable")) // (4 * self.FAN)
        self.order = np.lexsort((vectors[:, widest[1]], vectors[:, widest[0]], slices))
        self.levels = [(vectors[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > self.FAN:
            upper, least = self.levels[-1]
            cut = np.arange(0, len(upper), self.FAN)
            self.levels.append((np.maximum.reduceat(upper, cut, axis=0), np.minimum.reduceat(least, cut)))

    def pairs(self, t: Threshold, part: np.ndarray, rows: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points of different parts, each once, that the bound does not rule out, in runs of a bounded size."""
        part = part[self.order]
        points, sizes = self.levels[0]
        span = [self.FAN**d for d in range(len(self.levels))]

        def below(q: np.ndarray, at: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            upper, least = self.levels[depth]
            for k in range(0, len(q), rows):
                a, b = q[k : k + rows], at[k : k + rows]
                # Only what comes after a point in the tree's order, so each pair comes up once.
                later = (b + 1) * span[depth] - 1 > a
                if not depth:
                    later &= part[a] != part[b]
                a, b = a[later], b[later]
                bound = np.minimum(upper[b], points[a]).sum(axis=1, dtype=np.int64)
                keep = bound >= t.needed(sizes[a], least[b])
                a, b = a[keep], b[keep]
                if not len(a):
                    continue
                if not depth:
                    yield self.order[a], self.order[b]
                    continue
                child = (b[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                a = np.repeat(a, self.FAN)
                real = child < len(self.levels[depth - 1][0])
                yield from below(a[real], child[real], depth - 1)

        top = len(self.levels[-1][0])
        step = max(1, rows // max(1, top))
        for k in range(0, len(points), step):
            q = np.arange(k, min(len(points), k + step))
            yield from below(np.repeat(q, top), np.tile(np.arange(top), len(q)), len(self.levels) - 1)


def fine_dimensions(size: int) -> int:
    """Coordinates of finer vectors for sets of up to this size: about two a shingle, within bounds."""
    return min(MOST_FINE, max(FINE, 1 << int(2 * size - 1).bit_length())) if size else FINE


def tree_search(sets: list[np.ndarray], part: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """Links (indices) that tie sets of different parts, found by an R-tree of all of them.

    ``part`` says which sets are known to be together; it is kept up to date,
    and sets of one part are not verified, so the links are a forest. Sets are
    searched in classes of size, so finer vectors are as fine as they must be.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    # Sets so small that one shingle is too much of a difference have no partner but their equals.
    some = np.flatnonzero((sizes + sizes * t.q // t.p) * (t.q - t.p) >= t.q + t.p)
    out: list[tuple[int, int]] = []
    if len(some) < 2:
        return out
    order = some[np.argsort(sizes[some], kind="stable")]
    sizes_in_order = sizes[order]
    # A class starts where the sets are larger than any partner of those before; a long one is cut where a finer vector pays.
    start = 0
    while start < len(order):
        dimensions = fine_dimensions(int(sizes_in_order[start]))
        top = dimensions if dimensions < MOST_FINE else int(sizes_in_order[-1])
        stop = max(start + 1, int(np.searchsorted(sizes_in_order, top // 2 if dimensions < MOST_FINE else top, "right")))
        # Partners of the class's largest sets stand after it; they are searched with it, once.
        reach = int(np.searchsorted(sizes_in_order, int(sizes_in_order[stop - 1]) * t.q // t.p, "right"))
        _search(sets, order[start:reach], stop - start, sizes, part, t, dimensions, out)
        start = stop
    return out


def _search(sets: list[np.ndarray], mine: np.ndarray, own: int, sizes: np.ndarray, part: np.ndarray, t: Threshold, dimensions: int, out: list[tuple[int, int]]) -> None:
    """Links among the sets of ``mine`` with one end, at least, among the first ``own``."""
    if len(mine) < 2 or len(np.unique(part[mine])) < 2:
        return
    size = sizes[mine]
    fine = count_vectors([sets[i] for i in mine], dimensions)
    coarse = fine.reshape(len(mine), DIMENSIONS, dimensions // DIMENSIONS).sum(axis=2, dtype=np.int32)
    step = max(1, (1 << 22) // dimensions)
    for a, b in CountTree(coarse.astype(np.uint8 if coarse.max() < 256 else np.int32), size).pairs(t, part[mine]):
        wanted = np.minimum(a, b) < own
        a, b = a[wanted], b[wanted]
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            apart = part[mine[x]] != part[mine[y]]
            x, y = x[apart], y[apart]
            close = np.minimum(fine[x], fine[y]).sum(axis=1, dtype=np.int64) >= t.needed(size[x], size[y])
            for i, j in zip(mine[x[close]].tolist(), mine[y[close]].tolist(), strict=True):
                if part[i] != part[j] and t.linked(common_size(sets[i], sets[j]), int(sizes[i]), int(sizes[j])):
                    part[part == part[j]] = part[i]
                    out.append((i, j))


def tree_links(ids: list[int], roots: list[int], sets: list[np.ndarray], t: Threshold) -> list[tuple[int, int]]:
    """Links that join members known to be apart, a forest."""
    _, part = np.unique(roots, return_inverse=True)
    return [(ids[i], ids[j]) for i, j in tree_search(sets, part, t)]


# ------------------------------------------------------------ Spark operators

_BLOB = "kind int, bucket int, blob binary"
_BLOB_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
_KEYS, _PAIRS, _SIZES, _GROUPS = 0, 1, 2, 3
#: What is known of a candidate pair.
_OPEN, _NOT_LINKED, _LINKED = 0, 1, 2


def _repeated(ids: np.ndarray) -> np.ndarray:
    """True where an id stands in more than one row."""
    _, inverse, count = np.unique(ids, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def _blob(kind: int, bucket: int, *arrays: np.ndarray) -> dict:
    return {"kind": kind, "bucket": bucket, "blob": pack(*arrays)}


def _batched(batches: Iterator[pa.RecordBatch], n: int, batch_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(ids, is null, sets) of about ``batch_bytes`` of text at a time."""
    ids, null, sets, size = [], [], [], 0
    for batch in batches:
        for part in chunks(batch):
            text = Text(part.column(1))
            sets += shingle_sets(text, n)
            null.append(part.column(0).is_null().to_numpy(zero_copy_only=False))
            ids.append(part.column(0).fill_null(0).to_numpy())
            size += len(text.data)
            if size >= batch_bytes:
                yield np.concatenate(ids), np.concatenate(null), sets
                ids, null, sets, size = [], [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(null), sets


def _pair_blobs(low: np.ndarray, high: np.ndarray, told: np.ndarray, buckets: int) -> Iterator[dict]:
    """Pairs dealt by a hash of both ends, so all reports of a pair meet."""
    bucket = (mix(mix(low.astype(np.uint64)) + high.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        at = order[cut[b] : cut[b + 1]]
        if len(at):
            yield _blob(_PAIRS, b, low[at], high[at], told[at])


def _dealt(docs: DataFrame, n: int, t: Threshold, buckets: int, batch_bytes: int) -> DataFrame:
    """Candidate pairs (with the verdict where it is known) and set sizes, as blobs."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (ids, null, sets) in enumerate(_batched(batches, n, batch_bytes)):
            size = np.array([len(s) for s in sets], np.int64)
            rows = [_blob(_SIZES, turn % buckets, ids, null, size)]
            # Equal sets are tied first; one of them goes on.
            whole = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64) if sets else np.zeros(0, np.uint64)
            use = np.flatnonzero((size > 0) & ~null)
            first, low, high = stars(whole[use], ids[use])
            kept = use[first]
            position = {int(ids[k]): k for k in use[::-1]}
            twice = set(ids[_repeated(ids)].tolist())

            def verdicts(low: np.ndarray, high: np.ndarray, at: dict[int, int], sets=sets, twice=twice) -> np.ndarray:
                told = np.zeros(len(low), np.int8)
                for k, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                    told[k] = _LINKED if links(sets[at[a]], sets[at[b]], t) else _OPEN if a in twice or b in twice else _NOT_LINKED
                return told

            pairs = [(low, high, verdicts(low, high, position))]
            # The tree finds all links of the batch; keys that documents share without one are open beyond it.
            different = [sets[k] for k in kept]
            part = np.arange(len(different))
            tied = tree_search(different, part, t)
            ends = np.array(tied, np.int64).reshape(-1, 2)
            a, b = ids[kept[ends[:, 0]]], ids[kept[ends[:, 1]]]
            pairs.append((np.minimum(a, b)[a != b], np.maximum(a, b)[a != b], np.full(int((a != b).sum()), _LINKED, np.int8)))
            key, owner = keys_of(different, t)
            node = ids[kept][owner] if len(owner) else np.zeros(0, np.int64)
            _, low, high = stars(key, node)
            root = {int(ids[k]): int(part[i]) for i, k in reversed(list(enumerate(kept)))}
            open_here = np.array([root[x] != root[y] or x in twice or y in twice for x, y in zip(low.tolist(), high.tolist(), strict=True)], bool)
            low, high = low[open_here], high[open_here]
            told = np.array([_OPEN if x in twice or y in twice else _NOT_LINKED for x, y in zip(low.tolist(), high.tolist(), strict=True)], np.int8)
            pairs.append((low, high, told))
            low, high, told = (np.concatenate(x) for x in zip(*pairs, strict=True))
            rows += _pair_blobs(low.astype(np.int64), high.astype(np.int64), told, buckets)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                at = order[cut[b] : cut[b + 1]]
                if len(at):
                    rows.append(_blob(_KEYS, b, key[at], node[at].astype(np.int64)))
            yield pa.RecordBatch.from_pylist(rows, _BLOB_SCHEMA)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        bucket = None

        def tied() -> Iterator[dict]:
            if held:
                key, node = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                _, low, high = stars(key, node)
                yield from _pair_blobs(low, high, np.full(len(low), _OPEN, np.int8), buckets)
                # Two members are a pair of the star; of more, not all pairs are.
                group, node = groups_of(key, node)
                if len(group):
                    yield _blob(_GROUPS, bucket, group.view(np.int64), node)

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["kind"] != _KEYS:
                    rows.append(row)
                    continue
                if row["bucket"] != bucket:
                    rows += tied()
                    bucket = row["bucket"]
                held.append(unpack(row["blob"], np.uint64, np.int64))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _BLOB_SCHEMA)
        rows = list(tied())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _BLOB_SCHEMA)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a pair: the best and the least that is known of it."""
        held: list[list[np.ndarray]] = []
        bucket = None

        def settled() -> Iterator[dict]:
            if held:
                low, high, told = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order = np.lexsort((told, high, low))
                low, high, told = low[order], high[order], told[order]
                head = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
                yield _blob(_PAIRS, -1, low[head], high[head], told[np.append(head[1:], len(low)) - 1], told[head])

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["kind"] != _PAIRS:
                    rows.append(row)
                    continue
                if row["bucket"] != bucket:
                    rows += settled()
                    bucket = row["bucket"]
                held.append(unpack(row["blob"], np.int64, np.int64, np.int8))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _BLOB_SCHEMA)
        rows = list(settled())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _BLOB_SCHEMA)

    blobs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(deal), _BLOB)
    met = lambda df: df.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    return materialize(met(met(blobs).mapInArrow(lean(tie), _BLOB)).mapInArrow(lean(settle), _BLOB))


def _unpacked(blobs: DataFrame, kind: int, ddl: str, kinds: tuple[type, ...]) -> DataFrame:
    """Rows of the blobs of one kind."""
    null_at = 1 if kind == _SIZES else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                arrays = unpack(row.as_py(), *kinds)
                columns = [pa.array(a) for i, a in enumerate(arrays) if i != null_at]
                if null_at:
                    columns[0] = pa.array(arrays[0], mask=arrays[1])
                yield pa.RecordBatch.from_arrays(columns, names=[p.split()[0] for p in ddl.split(", ")])

    return blobs.filter(F.col("kind") == kind).select("blob").mapInArrow(run, ddl)


def _packed_texts(docs: DataFrame) -> DataFrame:
    """(id, zstd of the text): a text that travels costs a third of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [c.compress((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["id", "z"])

    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, z binary")


def _sets(packed: list[bytes], n: int) -> list[np.ndarray]:
    d = zstandard.ZstdDecompressor()
    out: list[np.ndarray] = []
    held, size = [], 0
    for z in packed:
        held.append(d.decompress(z))
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            out += shingle_sets(Text(pa.array(held, pa.large_binary())), n)
            held, size = [], 0
    return out + (shingle_sets(Text(pa.array(held, pa.large_binary())), n) if held else [])


def _verified(pairs: DataFrame, texts: DataFrame, n: int, t: Threshold) -> DataFrame:
    """(a, b) pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                sets = _sets(part.column(2).to_pylist() + part.column(3).to_pylist(), n)
                m = part.num_rows
                ok = [i for i in range(m) if links(sets[i], sets[m + i], t)]
                if ok:
                    yield part.select(["a", "b"]).take(pa.array(ok))

    x, y = texts.select(F.col("id").alias("a"), F.col("z").alias("za")), texts.select(F.col("id").alias("b"), F.col("z").alias("zb"))
    return pairs.select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "za", "zb").mapInArrow(lean(run), "a long, b long")


def _in_blocks(members: DataFrame, largest: DataFrame, t: Threshold, block: int) -> DataFrame:
    """(id, root, side, k, pair): members dealt to the pairs of blocks that they take part in."""
    at = join_salted(members, largest, ["k"], "n", "inner", F.col("id")).withColumn("side", ((F.col("root") == F.col("big")) & (F.col("n_all") > block)).cast("int"))
    at = at.withColumn("band", F.floor(F.ln(F.greatest(F.col("size"), F.lit(1))) / F.lit(math.log(t.q / t.p))).cast("int"))
    small = at.filter(F.col("n_all") <= block).select("id", "root", "side", "k", F.lit("all").alias("pair"))
    large = at.filter(F.col("n_all") > block).drop("n")
    count = lambda side: F.ceil(F.sum(F.when(F.col("side") == side, F.col("weight")).otherwise(0.0)) / F.lit(float(block))).cast("int")
    cells = materialize(large.groupBy("k", "band").agg(count(0).alias("rest"), count(1).alias("main"), F.count("*").alias("n")))
    # For each band, the numbers of blocks of the band before, of itself and of the next one.
    near = cells.select("k", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step"), (F.col("band") - F.col("step")).alias("band"), F.col("rest").alias("n_rest"), F.col("main").alias("n_main"))
    cells = materialize(cells.join(near.groupBy("k", "band").agg(F.collect_list(F.struct("step", "n_rest", "n_main")).alias("steps")), ["k", "band"]))
    placed = join_salted(large, cells, ["k", "band"], "n", "inner", F.col("id"))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.when(F.col("side") == 1, F.col("main")).otherwise(F.col("rest")))).cast("int"))
    placed = placed.drop("rest", "main", "n").withColumn("s", F.explode("steps")).select("*", "s.*").drop("s", "steps")
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    other = F.col("band") + F.col("step")
    name = lambda *x: F.concat_ws("/", *(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))

    def both(j: Column) -> Column:
        me, it = F.struct(F.col("band"), F.col("mine").alias("block")), F.struct(other.alias("band"), j.alias("block"))
        first, second = F.least(me, it), F.greatest(me, it)
        return name("rest", first["band"], first["block"], second["band"], second["block"])

    of_rest = F.concat(F.transform(upto("n_rest"), both), F.transform(upto("n_main"), lambda j: name("main", F.col("band"), F.col("mine"), other, j)))
    of_main = F.transform(upto("n_rest"), lambda i: name("main", other, i, F.col("band"), F.col("mine")))
    dealt = placed.select("id", "root", "side", "k", F.explode(F.when(F.col("side") == 1, of_main).otherwise(of_rest)).alias("pair"))
    return small.unionByName(dealt)


def _searched(members: DataFrame, texts: DataFrame, n: int, t: Threshold, block: int) -> DataFrame:
    """Links within unresolved components by R-tree; members: (id, root, k, size).

    A component of up to ``block`` members (large sets count for several) is
    one task. A larger one is cut by
    bands of set size (partners lie in the same band or the next one) and each
    band into blocks by a hash; tasks are pairs of blocks. Its largest known
    part is never compared with itself: its members (side 1) meet the blocks of
    the rest only.
    """
    members = members.withColumn("weight", F.greatest(F.lit(1.0), F.col("size") / HEAVY))
    parts = members.groupBy("k", "root").agg(F.count("*").alias("count"), F.sum("weight").alias("weight"))
    largest = materialize(parts.groupBy("k").agg(F.max_by("root", F.struct("count", "root")).alias("big"), F.sum("weight").alias("n_all"), F.sum("count").alias("n")))
    if (largest.agg(F.max("n_all")).first()[0] or 0) <= block:
        # No component is larger than a block: each is a task as it is.
        dealt = members.select("id", "root", F.lit(0).alias("side"), "k", F.lit("all").alias("pair"))
    else:
        dealt = _in_blocks(members, largest, t, block)
    dealt = dealt.withColumn("task", F.xxhash64("k", "pair"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> Iterator[pa.RecordBatch]:
            if len({r[3] for r in held}) > 1 and not all(r[4] for r in held):
                sets = _sets([r[5] for r in held], n)
                full = [i for i in range(len(held)) if len(sets[i])]
                if full:
                    out = tree_links([held[i][2] for i in full], [held[i][3] for i in full], [sets[i] for i in full], t)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and held[0][:2] != row[:2]:
                    yield from found()
                held.append(row)
        yield from found()

    rows = dealt.join(texts, "id").repartition("task").sortWithinPartitions("k", "pair").select("k", "pair", "id", "root", "side", "z")
    return rows.mapInArrow(lean(run), "a long, b long")


def sketch_dimensions(size: int) -> int:
    """Cells of a sketch: two to four shingles each, as far as it goes."""
    return min(1 << 14, max(DIMENSIONS, 1 << int(size // 4).bit_length()))


def close_pairs(sizes: np.ndarray, part: np.ndarray, sketches: list[np.ndarray], t: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (indices) of sets of different parts whose sketches do not rule a link out."""
    if len(np.unique(part)) < 2:
        return
    dimensions = min(map(len, sketches))
    fine = np.array([x.reshape(dimensions, -1).sum(axis=1) for x in sketches])
    fine = fine.astype(np.uint8) if fine.max() < 256 else fine
    if len(sizes) <= CountTree.FAN:
        a, b = np.triu_indices(len(sizes), 1)
        apart = part[a] != part[b]
        found = iter([(a[apart], b[apart])])
    else:
        coarse = fine.reshape(len(fine), DIMENSIONS, -1).sum(axis=2, dtype=np.int32)
        found = CountTree(coarse.astype(np.uint8) if coarse.max() < 256 else coarse, sizes).pairs(t, part)
    step = max(1, (1 << 22) // dimensions)
    for a, b in found:
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            close = np.minimum(fine[x], fine[y]).sum(axis=1, dtype=np.int64) >= t.needed(sizes[x], sizes[y])
            if close.any():
                yield x[close], y[close]


def _sketches(texts: DataFrame, n: int) -> DataFrame:
    """(id, size, sketch) of all packed texts with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                sets = _sets(part.column(1).to_pylist(), n)
                full = [i for i, s in enumerate(sets) if len(s)]
                made = [c.compress(count_vector(sets[i], sketch_dimensions(len(sets[i]))).astype(np.uint32).tobytes()) for i in full]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full, pa.int64())), pa.array([len(sets[i]) for i in full], pa.int64()), pa.array(made, pa.binary())], names=["id", "size", "sketch"])

    return texts.select("id", "z").mapInArrow(lean(run), "id long, size long, sketch binary")


def _by_keys(shared: DataFrame, texts: DataFrame, n: int, t: Threshold) -> DataFrame:
    """(a, b) pairs of different roots that share a key and that their sketches leave open; ``shared``: (key, id, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> Iterator[pa.RecordBatch]:
            if held:
                d = zstandard.ZstdDecompressor()
                ids = np.array([r[1] for r in held], np.int64)
                _, part = np.unique([r[2] for r in held], return_inverse=True)
                sketches = [np.frombuffer(d.decompress(r[4]), np.uint32) for r in held]
                for a, b in close_pairs(np.array([r[3] for r in held], np.int64), part, sketches, t):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], names=["a", "b"])
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and held[0][0] != row[0]:
                    yield from found()
                held.append(row)
        yield from found()

    rows = shared.join(_sketches(texts, n).hint("merge"), "id").repartition("key").sortWithinPartitions("key").select("key", "id", "root", "size", "sketch")
    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def _unsettled(members: DataFrame, blobs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(members to be searched by components, (key, id, root) of the others): components go by keys, unless texts are fewer rows."""
    groups = _unpacked(blobs, _GROUPS, "key long, id long", (np.int64, np.int64)).distinct()
    met = materialize(groups.join(members.select("id", "root", "k").hint("merge"), "id"))
    open_keys = met.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    shared = materialize(met.join(open_keys.hint("merge"), "key", "left_semi"))
    # A row of a task or block is a text, one of a key a sketch, of a tenth of its bytes or less; a member meets the blocks of three bands at most.
    each = members.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(1.0), F.col("size") / HEAVY)).alias("weight"))
    cost = each.join(shared.groupBy("k").agg(F.count("*").alias("by_key")).hint("merge"), "k", "left")
    whole = materialize(cost.filter(F.coalesce("by_key", F.lit(0)) > KEY_ROWS * F.col("n") * F.greatest(F.lit(1.0), F.col("weight") / block)).select("k"))
    return members.join(whole.hint("merge"), "k", "left_semi"), shared.join(whole.hint("merge"), "k", "left_anti").select("key", "id", "root")


def link_components(docs: DataFrame, n: int = 5, p: int = 4, q: int = 5, batch_bytes: int = BATCH_BYTES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((id, root) of all documents with links, (doc_id, n_shingles) of all rows).

    Links join documents whose sets of ``n``-word shingles (A-Z lowered) have a
    Jaccard similarity of p/q or more. Whole texts count; null or blank ones
    have no shingles and no links. Null ids take no part. Rows of one id are one
    document, linked by any of them. Repeated rows, clashing or further columns
    do not matter; an empty table gives empty results.
    """
    t = Threshold(p, q)
    buckets = bucket_count(docs)
    blobs = _dealt(docs, n, t, buckets, batch_bytes)
    pairs = _unpacked(blobs, _PAIRS, "a long, b long, most byte, least byte", (np.int64, np.int64, np.int8, np.int8))
    sizes = _unpacked(blobs, _SIZES, "doc_id long, n_shingles long", (np.int64, bool, np.int64))
    texts = _packed_texts(docs)
    good = pairs.filter(F.col("most") == _LINKED).select("a", "b")
    not_yet = pairs.filter(F.col("most") != _LINKED).select("a", "b")
    open_pairs = pairs.filter((F.col("most") != _LINKED) & (F.col("least") == _OPEN)).select("a", "b")
    if open_pairs.limit(1).count():
        ids = open_pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        # Ids grow with the corpus, so neither side is broadcast, at any size.
        chosen = materialize(texts.join(ids.hint("merge"), "id", "left_semi"))
        good = materialize(_verified(open_pairs, chosen, n, t).unionByName(good))
    found = components(good)
    labelled = lambda df, c: df.join(found.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    apart = materialize(labelled(labelled(not_yet, "a"), "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if apart.limit(1).count():
        groups = components(apart).select(F.col("id").alias("root"), F.col("root").alias("k"))
        singles = groups.select(F.col("root").alias("id"), "root")
        members = materialize(found.unionByName(singles).distinct().join(groups, "root").select("id", "root", "k"))
        size = sizes.groupBy(F.col("doc_id").alias("id")).agg(F.max("n_shingles").alias("size"))
        members = materialize(members.join(size.hint("merge"), "id"))
        whole, shared = (materialize(x) for x in _unsettled(members, blobs, block))
        wanted = whole.select("id").unionByName(shared.select("id")).distinct()
        held = materialize(texts.join(wanted.hint("merge"), "id", "left_semi"))
        maybe = materialize(_by_keys(shared, held, n, t))
        extra = [materialize(_searched(whole, held, n, t, block)), materialize(_verified(maybe, held, n, t))]
        found = components(reduce(DataFrame.unionByName, [good.select("a", "b"), *extra]))
    return found, sizes


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles at a similarity of 0.9."""
    found, sizes = link_components(read_table(spark, sf_dir, "documents"), 3, 90, 100)
    out = sizes.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component (5 words, 0.8) the smallest id stays, and all without links.

    Null and empty texts link with nothing and stay, as do null ids; rows of
    one id stay or go together; other columns pass through; an empty table
    stays empty.
    """
    found, _ = link_components(docs)
    losers = found.filter("id <> root").select(F.col("id").alias("doc_id"))
    return docs.join(losers, "doc_id", "left_anti").select(*docs.columns)
