"""Benchmark decontamination: a prefix-filtered set join.

A benchmark item's windows are its sequences of ``window`` words (an item of
fewer is one window). A document is contaminated where it contains a whole
window.

1. Pieces. Items are cut into pieces of a bounded number of windows, and
   pieces are dealt into blocks of bounded size. A block is all that is ever
   broadcast; a benchmark of any size is a number of blocks, each a set of
   queries against all documents.
2. Rarity. Sets are of shingles, three words each. One pass over all documents
   counts how often each shingle of the benchmark stands in them.
3. Prefix. A window is contained only if all of its shingles are, so with
   shingles ordered by rarity a prefix of one, the rarest, is necessary. Ties
   take the earlier one. A document's shingle that is no prefix joins nothing.
4. Bounds. The prefix stands at a known place in its window. Its position in
   the document gives the window's first and last word, which must lie within
   the document.
5. Verification. The remaining candidates are compared word by word, in bytes.

With one block each document's row is made where it is read. With several, the
hits of each block are gathered by row before they are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.common import Text, chunks, lean, lowered, materialize, mix, read_table, sequences

WINDOW = 10
SHINGLE = 3
#: Windows of a piece; its text holds ``window - 1`` words more.
PIECE_WINDOWS = 2_000
#: Bytes of item text that a block may hold, about (pieces are dealt by hash).
BLOCK_BYTES = 8_000_000

#: Fixed value: words are runs of these bytes, once A-Z are lower-case.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Words:
    """Lower-cased words of a chunk of texts: byte spans, rows and hashes."""

    def __init__(self, column: pa.Array):
        self.text = Text(column)
        self.text.data = lowered(self.text.data)
        self.n_rows = self.text.n
        self.start, self.end, self.row = self.text.spans(_WORD_BYTE[self.text.data])
        self.hash = self.text.hashes(self.start, self.end)
        self.text._sums = None
        self.first = np.searchsorted(self.row, np.arange(self.n_rows + 1))
        self.counts = np.diff(self.first)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``n`` words and the word that each begins at; none crosses rows."""
        m = len(self.row)
        at = np.flatnonzero(self.row[: m - n + 1] == self.row[n - 1 :]) if m >= n else np.zeros(0, np.int64)
        return sequences(self.hash, at, n), at


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of every window of every row."""
    count = np.where(words.counts > 0, np.maximum(words.counts - window + 1, 1), 0)
    total = int(count.sum())
    first = np.arange(total) + np.repeat(words.first[:-1] - (np.cumsum(count) - count), count)
    return first, np.repeat(np.minimum(words.counts, window), count)


def pieces(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, piece_windows: int = PIECE_WINDOWS) -> DataFrame:
    """(item, words, bytes): every window of every item in one piece; ids as strings, null as ``null``; equal pieces of an item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, batch.schema.names[1]):
                words = Words(part.column(1))
                ids, out = part.column(0).to_pylist(), []
                for r, count in enumerate(words.counts.tolist()):
                    for at in range(0, max(count - window + 1, 1) if count else 0, piece_windows):
                        of = words.first[r] + np.arange(at, min(count, at + piece_windows + window - 1))
                        out.append((ids[r], b" ".join(words.text.data[s:e].tobytes() for s, e in zip(words.start[of], words.end[of]))))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.string()), pa.array([w for _, w in out], pa.binary()).cast(pa.string())], names=["item", "words"])

    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("words"))
    return named.mapInArrow(run, "item string, words string").distinct().withColumn("bytes", F.octet_length("words").cast("long"))


class Block:
    """Windows of a block of pieces, found by their rarest shingle."""

    def __init__(self, items: list[str], texts: list[str], window: int, shingle: int):
        self.names = sorted(set(items))
        number = {name: i for i, name in enumerate(self.names)}
        self.words = Words(pa.array(texts, pa.large_string()))
        self.item = np.array([number[i] for i in items], np.int64)[self.words.row] if len(items) else np.zeros(0, np.int64)
        self.first, self.length = _windows(self.words, window)
        self.size = shingle

    def vocabulary(self) -> dict[int, np.ndarray]:
        """Sorted hashes of the windows' shingles, by the number of words of a shingle."""
        return {n: np.unique(h) for n, h in ((n, self._shingles(n)[0]) for n in self._sizes()) if len(h)}

    def _sizes(self) -> list[int]:
        return sorted({min(self.size, int(k)) for k in np.unique(self.length)})

    def _shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of ``n`` words of the pieces that have such windows."""
        h, at = self.words.shingles(n)
        kept = np.minimum(self.words.counts, self.size)[self.words.row[at]] == n
        return h[kept], at[kept]

    def index(self, seen: dict[int, dict[int, int]]) -> None:
        """Choose each window's prefix by how often its shingles were ``seen`` and sort windows by it."""
        self.prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in self._sizes():
            h, at = self._shingles(n)
            found = seen.get(n, {})
            rarity = np.full(len(self.words.row), np.iinfo(np.int64).max)
            rarity[at] = [found.get(k, 0) for k in h.view(np.int64).tolist()]
            key = np.zeros(len(self.words.row), np.uint64)
            key[at] = h
            mine = np.flatnonzero(np.minimum(self.length, self.size) == n)
            best, place = None, None
            for j in range(int(self.length[mine].max(initial=0)) - n + 1):
                inside = j <= self.length[mine] - n
                r = np.where(inside, rarity[np.minimum(self.first[mine] + j, len(rarity) - 1)], np.iinfo(np.int64).max)
                if best is None:
                    best, place = r, np.zeros(len(mine), np.int64)
                else:
                    rarer = r < best
                    best, place = np.where(rarer, r, best), np.where(rarer, j, place)
            # What no document contains is no candidate.
            met = best > 0
            mine, place = mine[met], place[met]
            prefix = key[self.first[mine] + place]
            order = np.argsort(prefix, kind="stable")
            self.prefixes[n] = (prefix[order], mine[order], place[order])

    def matches(self, docs: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word in the chunk, number of words, item number) of every window that a document contains."""
        out = []
        for n, (prefix, window, place) in self.prefixes.items():
            if not len(prefix):
                continue
            h, at = docs.shingles(n)
            lo = np.searchsorted(prefix, h, "left")
            known = np.flatnonzero(prefix[np.minimum(lo, len(prefix) - 1)] == h)
            lo, h, at = lo[known], h[known], at[known]
            times = np.searchsorted(prefix, h, "right") - lo
            for a, b in _ranges(times):
                t = times[a:b]
                j = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t) + np.repeat(lo[a:b], t)
                w, first = window[j], np.repeat(at[a:b], t) - place[j]
                length = self.length[w]
                row = docs.row[np.repeat(at[a:b], t)]
                # Positional and length bounds: the window lies within the document.
                inside = (first >= docs.first[row]) & (first + length <= docs.first[row + 1])
                out.append(self._verified(docs, first[inside], w[inside]))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        first, w = (np.concatenate(x) for x in zip(*out))
        return first, self.length[w], self.item[self.first[w]]

    def _verified(self, docs: Words, first: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates whose words are those of the window, by hash and then by byte."""
        length = self.length[w]
        for j in range(int(length.max(initial=0))):
            of = np.minimum(j, length - 1)
            same = docs.hash[first + of] == self.words.hash[self.first[w] + of]
            first, w, length = first[same], w[same], length[same]
        for j in range(int(length.max(initial=0))):
            of = np.minimum(j, length - 1)
            same = _equal_bytes(docs, first + of, self.words, self.first[w] + of)
            first, w, length = first[same], w[same], length[same]
        return first, w


def _equal_bytes(a: Words, i: np.ndarray, b: Words, k: np.ndarray) -> np.ndarray:
    """Whether words ``i`` of ``a`` and ``k`` of ``b`` have equal bytes."""
    size = a.end[i] - a.start[i]
    same = size == b.end[k] - b.start[k]
    at = np.flatnonzero(same)
    size = size[at]
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    differs = a.text.data[np.repeat(a.start[i[at]], size) + within] != b.text.data[np.repeat(b.start[k[at]], size) + within]
    same[np.repeat(at, size)[differs]] = False
    return same


def _ranges(times: np.ndarray, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of shingles that meet ``limit`` windows at most, or of one shingle."""
    total, at = np.cumsum(times), 0
    while at < len(times):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield at, stop
        at = stop


def _blocks(cut: DataFrame, window: int, shingle: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark's pieces as blocks, one at a time."""
    size = cut.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    if n > 1:
        cut = materialize(cut.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n))))
    for k in range(n):
        rows = (cut.filter(F.col("block") == k) if n > 1 else cut).select("item", "words").toArrow()
        yield Block(rows.column(0).to_pylist(), rows.column(1).to_pylist(), window, shingle)


def _seen(docs: DataFrame, text: str, block: Block) -> dict[int, dict[int, int]]:
    """How often each shingle of a block stands in all documents; a task combines its counts before they move."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block.vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        totals = {n: np.zeros(len(v), np.int64) for n, v in vocabulary.items()}
        for batch in batches:
            for part in chunks(batch, batch.schema.names[0]):
                words = Words(part.column(0))
                for n, v in vocabulary.items():
                    h, _ = words.shingles(n)
                    at = np.minimum(np.searchsorted(v, h), len(v) - 1)
                    totals[n] += np.bincount(at[v[at] == h], minlength=len(v))
        for n, v in vocabulary.items():
            met = totals[n] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(met.sum()), n, np.int32)), pa.array(v[met].view(np.int64)), pa.array(totals[n][met])], names=["size", "shingle", "times"])

    counted = docs.select(text).mapInArrow(lean(run), "size int, shingle long, times long").groupBy("size", "shingle").agg(F.sum("times").alias("times"))
    # One row a shingle of the block at most, so its size is the block's.
    out: dict[int, dict[int, int]] = {}
    for n, key, times in zip(*(c.to_pylist() for c in counted.toArrow().columns)):
        out.setdefault(n, {})[key] = times
    shared.unpersist()
    return out


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def _covered(n_words: int, first: np.ndarray, length: np.ndarray) -> int:
    """Words within any of the given windows."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + length, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _row_hits(docs: Words, found: tuple[np.ndarray, np.ndarray, np.ndarray], names: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """(row, first word within the row, number of words, sorted item ids) of every row with a match."""
    first, length, item = found
    row = docs.row[first]
    order = np.lexsort((first, row))
    first, length, item, row = first[order], length[order], item[order], row[order]
    rows, begins = np.unique(row, return_index=True)
    for r, a, b in zip(rows.tolist(), begins.tolist(), [*begins[1:].tolist(), len(row)]):
        yield r, first[a:b] - docs.first[r], length[a:b], [names[k] for k in np.unique(item[a:b])]


OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
    piece_windows: int = PIECE_WINDOWS,
) -> DataFrame:
    """One row a document: its key, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Whole texts are read; null and empty texts have no words and are clean;
    null and empty items have no windows. Null keys and repeated rows stay,
    each with its own result; items of one id count once, a null id as
    ``null``; other columns are ignored; without items every document is
    clean, and an empty table gives no rows.
    """
    if not 1 <= shingle <= window:
        raise ValueError("a shingle has 1 word at least and a window's at most")
    kind, shared = dict(docs.dtypes)[key], []
    for block in _blocks(pieces(items, item_id, item_text, window, piece_windows), window, shingle, block_bytes):
        block.index(_seen(docs, text, block))
        shared.append(docs.sparkSession.sparkContext.broadcast(block))
    if len(shared) == 1:
        return docs.select(key, text).mapInArrow(_whole(key, shared[0]), f"`{key}` {kind}, {OUT}, items array<string>")
    rows = docs.select(F.col(key), F.col(text), F.xxhash64(text).alias("__text"), F.octet_length(text).alias("__size"))
    hits = None
    for one in shared:
        part = rows.mapInArrow(_partial(one), f"key {kind}, digest long, size int, first array<int>, length array<int>, items array<string>")
        hits = part if hits is None else hits.unionByName(part)
    # A row's hits are as many as its words times the windows at one place, and few rows have any.
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    hits = hits.distinct().groupBy("key", "digest", "size").agg(flat("first"), flat("length"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    told = rows.mapInArrow(_counted, f"key {kind}, digest long, size int, n_words long")
    same = told["key"].eqNullSafe(hits["key"]) & told["digest"].eqNullSafe(hits["digest"]) & told["size"].eqNullSafe(hits["size"])
    both = told.join(hits, same, "left").select(told["key"], "n_words", "first", "length", "items")
    return both.mapInArrow(_merged(key), f"`{key}` {kind}, {OUT}, items array<string>")


def _whole(key: str, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        clean = _digest([])
        for batch in batches:
            for part in chunks(batch, batch.schema.names[1]):
                words = Words(part.column(1))
                n = words.n_rows
                hit, named, digests = [0] * n, [[]] * n, [clean] * n
                for r, first, length, names in _row_hits(words, block.matches(words), block.names):
                    hit[r], named[r], digests[r] = _covered(int(words.counts[r]), first, length), names, _digest(names)
                yield _rows(key, part.column(0), words.counts, hit, named, digests)

    return lean(run)


def _rows(key: str, keys: pa.Array, counts, hit: list[int], named: list[list[str]], digests: list[str]) -> pa.RecordBatch:
    columns = [keys, pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in named], pa.int64()), pa.array(digests, pa.string())]
    columns += [pa.array([h > 0 for h in hit], pa.bool_()), pa.array(named, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


def _partial(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for part in chunks(batch, batch.schema.names[1]):
                words = Words(part.column(1))
                found = list(_row_hits(words, block.matches(words), block.names))
                at = pa.array([r for r, *_ in found], pa.int64())
                ints = lambda k: pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(2).take(at), part.column(3).take(at), ints(1), ints(2), pa.array([f[3] for f in found], pa.list_(pa.string()))],
                    names=["key", "digest", "size", "first", "length", "items"],
                )

    return lean(run)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, batch.schema.names[1]):
            counts = Words(part.column(1)).counts
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(counts, pa.int64())], names=["key", "digest", "size", "n_words"])


def _merged(key: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, named, digests = [], [], []
            for n, first, length, names in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                hit.append(_covered(n, np.array(first, np.int64), np.array(length, np.int64)) if first else 0)
                named.append(sorted(names or []))
                digests.append(_digest(named[-1]))
            yield _rows(key, batch.column(0), batch.column(1), hit, named, digests)

    return run


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH doc_words AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), item_words AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), found AS (
  SELECT d.doc_id, d.i, d.n, t.item FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.words = t.words
), hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hits h USING (doc_id) LEFT JOIN named m USING (doc_id)
"""
