"""Periodic run detection: a harmonic grid of longest common extensions.

A run is a stretch of consecutive words with smallest period q, at least
``min_length`` and ``min_exponent * q`` long, that no neighbouring word
extends. Within each text:

1. Segments. Each n-gram of a run (n from :func:`gram_size`) stands in the text
   once more, one period away. So runs lie within maximal stretches of
   n-grams that recur in their text; all other words are left out, exactly.
2. Suffix arrays of the segments and of the reversed segments, by prefix
   doubling; the ranks of each doubling give the common prefixes of
   neighbouring suffixes, and a sparse table of their minima answers range
   minimum queries. The longest common extension of any two positions is then
   two look-ups, forward or backward.
3. Grid. For each period p the positions p, 2p, 3p, ... are compared with the
   next one, forward and backward. A run of period p covers two neighbouring
   grid points, and what both extensions span is the whole of it. The number
   of queries for a segment of m words is about m ln m. Multiples of a run's
   smallest period span the same words, so the least one found is kept.

Texts are handled in chunks of bounded size (one text at least), nothing is
shuffled, and the grid is walked in blocks, so a task's memory follows its
longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm.common import Text, chunks, lean, read_table, sequences

#: Grid points that are compared in one numpy pass.
GRID_BLOCK = 1_000_000


def gram_size(min_length: int, min_exponent: int = 3) -> int:
    """Largest n for which all n-grams of a run recur one period away.

    An n-gram of a run [s, e) has its copy after it if it starts by
    e - n - p, and before it if it starts from s + p on; no start is left out
    if the length is 2p + n - 1 or more. With lengths from 3p that holds for
    p >= n - 1; shorter periods need ``min_length`` >= 2(n - 2) + n - 1.
    """
    if min_exponent < 3:
        raise ValueError("the segments' rule holds for exponents of 3 and more")
    return max(1, (min_length + 5) // 3)


@dataclass(frozen=True)
class Runs:
    """Runs of a chunk, sorted by row, start and period; starts are word numbers within the row."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


class Extensions:
    """Longest common extensions of positions of one integer string made of segments.

    ``units`` must differ between segments, so that no match crosses them.
    """

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.n = n
        _, rank = np.unique(units, return_inverse=True)
        rank = rank.astype(np.int64)
        levels, order = [], np.argsort(rank, kind="stable")
        width = 1
        while True:
            levels.append(rank.astype(np.int32))
            sorted_rank = rank[order]
            if n < 2 or bool((sorted_rank[1:] != sorted_rank[:-1]).all()):
                break
            after = np.zeros(n, np.int64)
            if width < n:
                after[: n - width] = rank[width:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            k = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(k[1:] != k[:-1]))) if n else 0
            width *= 2
        self.rank = rank.astype(np.int32)
        # Common prefixes of neighbours in suffix order, by descending doublings.
        a, b = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(max(n - 1, 0), np.int32)
        for level in range(len(levels) - 1, -1, -1):
            ranks, step = levels[level], 1 << level
            inside = np.flatnonzero((a + step <= n) & (b + step <= n))
            same = inside[ranks[a[inside]] == ranks[b[inside]]]
            lcp[same] += step
            a[same] += step
            b[same] += step
        del levels
        self.table = [lcp]
        step = 1
        while 2 * step <= len(lcp):
            low = self.table[-1]
            self.table.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def lengths(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Number of equal units from ``i`` and ``k`` on; positions at the end have none. ``i`` differs from ``k``."""
        out = np.zeros(len(i), np.int64)
        at = np.flatnonzero((i < self.n) & (k < self.n))
        r, s = self.rank[i[at]].astype(np.int64), self.rank[k[at]].astype(np.int64)
        lo, hi = np.minimum(r, s), np.maximum(r, s)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        found = np.zeros(len(at), np.int64)
        for d in np.unique(level):
            of = np.flatnonzero(level == d)
            found[of] = np.minimum(self.table[d][lo[of]], self.table[d][hi[of] - (1 << int(d))])
        out[at] = found
        return out


def _segments(grams: np.ndarray, row: np.ndarray, n: int, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [start, end) of words whose n-grams recur in their row. ``grams``: hashes by word, ``row``: rows of words."""
    m = len(row)
    if m < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[: m - n + 1] == row[n - 1 :])
    key, of = grams[first], row[first]
    order = np.lexsort((key, of))
    same = (key[order[1:]] == key[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    again = np.zeros(len(first), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    at = first[again]
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(row[at]) != 0))
    start, end = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + n
    long = end - start >= min_length
    return start[long], end[long]


def _grid(base: np.ndarray, size: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (segment, period, grid position): positions from the segment's start, ``GRID_BLOCK`` of them at most where a period allows it."""
    most = size // min_exponent
    for lo, hi in _blocks(most, GRID_BLOCK):
        segment = np.repeat(np.arange(lo, hi), most[lo:hi])
        period = np.arange(len(segment)) - np.repeat(np.cumsum(most[lo:hi]) - most[lo:hi], most[lo:hi]) + 1
        points = (size[segment] - 1) // period
        for a, b in _blocks(points, GRID_BLOCK):
            times = points[a:b]
            j = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            p = np.repeat(period[a:b], times)
            yield np.repeat(segment[a:b], times), p, j * p


def _blocks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes sum to ``limit`` at most, or of one item."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield at, stop
        at = stop


def find_runs(ids: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run within segments [start, end) of a chunk's words.

    ``ids``: one integer a word of the segments laid end to end, equal for
    equal words.
    """
    size = end - start
    base = np.cumsum(size) - size
    n = int(size.sum())
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    segment = np.repeat(np.arange(len(size)), size)
    units = segment * (int(ids.max()) + 1) + ids
    forward, found = Extensions(units), []
    pending = []
    for of, p, offset in _grid(base, size, min_length, min_exponent):
        i = base[of] + offset
        near = np.flatnonzero(units[i] == units[i + p])
        of, p, i = of[near], p[near], i[near]
        ahead = forward.lengths(i, i + p)
        # The first grid point of a run has more than all but two of its periods ahead of it; the later ones of a stretch say the same.
        keep = ahead >= (min_exponent - 2) * p
        of, p, i, ahead = of[keep], p[keep], i[keep], ahead[keep]
        if len(of):
            fresh = np.ones(len(of), bool)
            fresh[1:] = (of[1:] != of[:-1]) | (p[1:] != p[:-1]) | (i[1:] - i[:-1] != p[1:]) | (ahead[:-1] != ahead[1:] + p[1:])
            pending.append((of[fresh], p[fresh], i[fresh], ahead[fresh]))
    del forward
    of, p, i, ahead = (np.concatenate(x) for x in zip(*pending)) if pending else (np.zeros(0, np.int64),) * 4
    if len(of):
        backward = Extensions(units[::-1])
        # Reversed, the word before position i is number n - i.
        behind = np.concatenate([backward.lengths(n - i[a:b], n - i[a:b] - p[a:b]) for a, b in _blocks(np.ones(len(i), np.int64), GRID_BLOCK)])
        s, e = i - behind, i + p + ahead
        whole = e - s >= np.maximum(min_length, min_exponent * p)
        found = np.stack([s[whole], e[whole], p[whole], of[whole]])
    if not len(found) or not found.shape[1]:
        z = np.zeros(0, np.int64)
        return z, z, z
    s, e, p, of = found
    order = np.lexsort((p, e, s))
    s, e, p, of = s[order], e[order], p[order], of[order]
    first = np.concatenate(([True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])))
    s, e, p, of = s[first], e[first], p[first], of[first]
    shift = start[of] - base[of]
    return s + shift, e + shift, p


def chunk_runs(text: Text, start: np.ndarray, end: np.ndarray, row: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> Runs:
    """Runs of the words with byte spans ``start``, ``end`` (in reading order, rows ascending) of a chunk's rows."""
    n = gram_size(min_length, min_exponent)
    m = len(start)
    grams = np.zeros(m, np.uint64)
    if m >= n:
        grams[: m - n + 1] = sequences(text.hashes(start, end), np.arange(m - n + 1), n)
    lo, hi = _segments(grams, row, n, min_length)
    size = hi - lo
    at = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
    words = pa.array([text.data[a:b].tobytes() for a, b in zip(start[at], end[at])], pa.large_binary())
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    s, e, p = find_runs(ids, row, lo, hi, min_length, min_exponent)
    first = np.searchsorted(row, row[s]) if len(s) else s
    order = np.lexsort((p, s))
    return Runs(row[s][order], (s - first)[order], (e - s)[order], p[order])


def joined(text: Text, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> list[bytes]:
    """Words of each row joined by one space."""
    size = end - start + 1
    total = int(size.sum())
    to = np.cumsum(size) - size
    index = np.arange(total) + np.repeat(start - to, size)
    gap = to + size - 1
    index[gap] = 0
    out = text.data[index] if len(text.data) else np.zeros(total, np.uint8)
    out[gap] = 0x20
    ends = np.searchsorted(row, np.arange(text.n), "right")
    begins = np.searchsorted(row, np.arange(text.n), "left")
    bounds = np.append(to, total)
    return [out[bounds[a] : max(bounds[b] - 1, bounds[a])].tobytes() for a, b in zip(begins, ends)]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's test texts: word numbers that a tenth of the documents read instead of 0 .. n - 1, a stretch repeated to the end."""
    h = zlib.crc32(str("null" if doc_id is None else doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % p
    return i


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_LONG = ("n_runs", "start", "length", "period", "exponent_milli")


def _describe(found: Runs, n_rows: int) -> list[tuple[list, str]]:
    """Per row: the five numbers and the digest of the list of runs."""
    counts = np.bincount(found.row, minlength=n_rows)
    # Quotients of integers below 2^26 differ as doubles when they differ.
    best_order = np.lexsort((found.period, found.start, -(found.length / np.maximum(found.period, 1)), found.row))
    begins = np.cumsum(counts) - counts
    out = []
    for r in range(n_rows):
        c, at = int(counts[r]), int(begins[r])
        if not c:
            out.append(([0, None, None, None, None], hashlib.sha256(b"").hexdigest()))
            continue
        k = best_order[at]
        s, length, p = int(found.start[k]), int(found.length[k]), int(found.period[k])
        lines = "".join(f"{a},{b},{q}\n" for a, b, q in zip(found.start[at : at + c].tolist(), found.length[at : at + c].tolist(), found.period[at : at + c].tolist()))
        out.append(([c, s, length, p, 1000 * length // p], hashlib.sha256(lines.encode()).hexdigest()))
    return out


def _kept(found: Runs, row: np.ndarray) -> np.ndarray:
    """False for the words that a run contains after its first period."""
    first = np.searchsorted(row, found.row)
    edges = np.zeros(len(row) + 1, np.int64)
    np.add.at(edges, first + found.start + found.period, 1)
    np.add.at(edges, first + found.start + found.length, -1)
    return np.cumsum(edges[:-1]) == 0


def _worker(key: str, order: Callable[[object, int], np.ndarray | None] | None, min_length: int, min_exponent: int, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, batch.schema.names[1]):
                text = Text(part.column(1))
                start, end, row = text.words()
                if order is not None:
                    counts = np.bincount(row, minlength=text.n)
                    at = np.arange(len(row))
                    for r, (k, c, b) in enumerate(zip(part.column(0).to_pylist(), counts.tolist(), (np.cumsum(counts) - counts).tolist())):
                        moved = order(k, c)
                        if moved is not None:
                            at[b : b + c] = b + moved
                    start, end = start[at], end[at]
                found = chunk_runs(text, start, end, row, min_length, min_exponent)
                keep = _kept(found, row)
                texts = joined(text, start[keep], end[keep], row[keep])
                told = _describe(found, text.n)
                columns = [part.column(0)]
                columns += [pa.array([t[0][i] for t in told], pa.int64()) for i in range(len(_LONG))]
                columns.append(pa.array([t[1] for t in told]))
                columns.append(pa.array([hashlib.sha256(t).hexdigest() for t in texts]))
                names = [key, *_LONG, "runs_sha256", "collapsed_sha256"]
                if with_text:
                    columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                    per_row = [[] for _ in range(text.n)]
                    for r, s, length, p in zip(found.row.tolist(), found.start.tolist(), found.length.tolist(), found.period.tolist()):
                        per_row[r].append({"start": s, "length": length, "period": p})
                    columns.append(pa.array(per_row, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))))
                    names += ["collapsed", "runs"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return lean(run)


def collapse_runs(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    min_length: int = 24,
    min_exponent: int = 3,
    order: Callable[[object, int], np.ndarray | None] | None = None,
    with_text: bool = True,
) -> DataFrame:
    """One row a document: its runs, the longest by exponent, digests, and the text without repeated periods.

    ``collapsed`` keeps each run's first period; ``runs`` lists (start,
    length, period). ``order`` may give other word numbers to read a text by.
    Whole texts are read; null and empty texts have no runs and collapse to
    nothing. Null keys and repeated rows stay, each row on its own; other
    columns, whatever their names, are ignored; an empty table gives no rows.
    A tie for the greatest exponent goes to the smallest start, then period.
    """
    kind = dict(docs.dtypes)[key]
    more = ", collapsed string, runs array<struct<start: long, length: long, period: long>>" if with_text else ""
    return docs.select(key, text).mapInArrow(_worker(key, order, min_length, min_exponent, with_text), f"`{key}` {kind}, {SCHEMA}{more}")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which are read with a repeated stretch at their end."""
    return collapse_runs(read_table(spark, sf_dir, "documents"), order=planted, with_text=False)
