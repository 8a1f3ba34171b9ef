"""Suffix-array dedup by prefix-free parsing.

Every byte that lies in a 100-byte string which also starts earlier is
removed. Suffixes need an order only where text recurs, and a parse finds
those places:

1. Parse. A rolling hash runs over 32-byte grams; the smallest hash among the
   grams of a 100-byte window is the window's trigger. Triggers depend on the
   window's bytes alone, so equal windows have the same one at the same offset.
   (The smallest hash, and not a hash that is 0 by some modulus, bounds a
   phrase's length.) A phrase is the run of windows with one trigger.
2. Dictionary. Phrases with equal bytes are one entry. Of its occurrences all
   but the first are repeats, decided at once. An entry whose trigger occurs
   in no other entry holds no repeat.
3. What is left are entries that share a trigger but differ around it. Entries
   are dealt by trigger; within a task they form a text whose own prefix-free
   parse (8-byte triggers) gives a small dictionary and a parse. The suffix
   arrays of both are built by prefix doubling and combined: a suffix is
   ordered by its rest of the phrase, then by the rank of the parse after it.
   In that order windows with equal bytes stand together; a comparison of the
   bytes confirms them, and all but the first are repeats.

The entries of a trigger that very many share are parsed once more, by the
next smallest hash of each window: equal windows have that in common too, and
the finer entries are dealt by both. A task that still meets more entries of
one trigger than it orders at a time does the same with a further hash, so no
task's memory grows with one passage and every window is decided in the order
of suffixes. Occurrences are combined within a batch before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.common import Text, bucket_count, chunks, flat, lean, materialize, mix, pack, read_table, record_batches, unpack

WINDOW = 100
GRAM = 32
REACH = WINDOW - GRAM + 1
#: Entries of one trigger above which they are parsed by a second one before they are dealt.
HOT_ENTRIES = 10_000
BATCH_BYTES = 16_000_000
#: Bytes of text that are parsed, and of entries that are ordered, in one numpy pass.
PASS_BYTES = 1_000_000
NULL_ID = np.iinfo(np.int64).min

_BLOB = "kind int, bucket int, blob binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
#: Kinds of blobs: phrases; repeats and open phrases by document; texts; entries to be ordered.
_PHRASES, _REPEATS, _OPEN, _TEXTS, _ENTRIES = range(5)


def _home(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` entries."""
    out, done = a, 1
    while done * 2 <= width:
        out, done = np.minimum(out[:-done], out[done:]), done * 2
    return np.minimum(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def phrases(text: Text) -> tuple[np.ndarray, ...]:
    """Parse of a chunk: (row, start, windows, trigger hash, content hash) of every phrase.

    ``start`` counts from the row's first byte; a phrase of n windows spans
    n + 99 bytes. Texts under 100 bytes have none.
    """
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    m = len(text.data)
    if m < WINDOW:
        return none
    at = np.arange(m - GRAM + 1)
    gram = text.hashes(at, at + GRAM)
    ranked = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    trigger = (_sliding_min(ranked, REACH) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(trigger))
    row = np.searchsorted(text.off, start, "right") - 1
    inside = start + WINDOW <= text.off[1:][row]
    start, trigger, row = start[inside], trigger[inside], row[inside]
    if not len(start):
        return none
    head = np.flatnonzero(np.append(True, (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])))
    count = np.diff(np.append(head, len(start)))
    first = start[head]
    content = text.hashes(first, first + count + WINDOW - 1)
    return row[head], first - text.off[row[head]], count, gram[trigger[head]], content


def _view(data: np.ndarray, off: np.ndarray) -> Text:
    """Bytes and offsets as a chunk of texts."""
    text = Text(pa.array([], pa.string()))
    text.data, text.off, text.n, text._sums = data, off, len(off) - 1, None
    return text


def finer(data: np.ndarray, off: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """Parse of entries by a further trigger: (entry, offset, windows, trigger hash, content hash) of every part.

    All windows of an entry ``data[off[i]:off[i+1]]`` have its ``level``
    smallest grams in common; the next smallest one of a window is what is
    parsed by, a function of the window's bytes as the first was.
    """
    text = _view(data, off)
    m = len(data)
    at = np.arange(m - GRAM + 1)
    gram = text.hashes(at, at + GRAM)
    ranked = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    # Grams that reach over an entry's end are no one's.
    row = np.searchsorted(off, at, "right") - 1
    ranked[at + GRAM > off[1:][row]] = top
    for _ in range(level):
        least = np.minimum.reduceat(ranked, off[:-1])
        ranked[(least[least != top] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = top
    best = _sliding_min(ranked, REACH)
    start = np.arange(len(best))
    row = row[: len(best)]
    inside = start + WINDOW <= off[1:][row]
    start, best, row = start[inside], best[inside], row[inside]
    trigger = np.where(best == top, np.uint64(0), best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (row[1:] != row[:-1])))
    count = np.diff(np.append(head, len(start)))
    first = start[head]
    hashed = np.where(best[head] == top, np.uint64(0), gram[trigger[head]])
    return row[head], first - off[row[head]], count, hashed, text.hashes(first, first + count + WINDOW - 1)


def _first_of(groups: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by groups, then place: (order, heads of groups, later than its group's first)."""
    order = np.lexsort((start, doc, *reversed(groups)))
    head = np.ones(len(order), bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for g in groups:
            s = g[order]
            same &= s[1:] == s[:-1]
        head[1:] = ~same
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else np.zeros(0, np.int64)
    d, p = doc[order], start[order]
    later = (d != d[lead]) | (p != p[lead])
    return order, head, later


def _ranges(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts, adjacent ones joined, ordered by place."""
    order = np.lexsort((start, doc))
    d, p, e = doc[order], start[order], (start + count)[order]
    if not len(d):
        return d, p, e
    fresh = np.append(True, (d[1:] != d[:-1]) | (p[1:] > e[:-1]))
    head = np.flatnonzero(fresh)
    return d[head], p[head], np.maximum.reduceat(e, head) - p[head]


def _by_home(kind: int, buckets: int, doc: np.ndarray, *arrays: np.ndarray) -> Iterator[dict]:
    """Blobs of rows dealt by their document's bucket."""
    home = _home(doc, buckets)
    order = np.argsort(home, kind="stable")
    cut = np.searchsorted(home[order], np.arange(buckets + 1))
    for b in range(buckets):
        at = order[cut[b] : cut[b + 1]]
        if len(at):
            yield {"kind": kind, "bucket": b, "blob": pack(doc[at], *(a[at] for a in arrays))}


# ---------------------------------------------------- suffix order of a task


def _doubled(rank: np.ndarray, reach: int, left: np.ndarray, longest: int) -> np.ndarray:
    """Prefix doubling: ranks of suffixes that end where ``left`` says, from ranks of ``reach`` symbols."""
    n = len(rank)
    # Ranks from a longer array have gaps; below n, a rank and the one ahead of it make one number.
    _, rank = np.unique(rank, return_inverse=True)
    while reach < longest:
        ahead = np.zeros(n, np.int64)
        far = np.flatnonzero(left > reach)
        ahead[far] = rank[far + reach] + 1
        _, rank = np.unique(rank * np.int64(n + 2) + ahead, return_inverse=True)
        reach *= 2
    return rank


def suffix_order(data: np.ndarray, off: np.ndarray, pick: np.ndarray, trigger: int = 8, every: int = 16) -> np.ndarray:
    """Order the suffixes at ``pick`` of texts ``data[off[i]:off[i+1]]``.

    A prefix-free parse cuts the texts where a rolling hash over ``trigger``
    bytes is 0 modulo ``every``; phrases overlap by ``trigger`` bytes. The
    suffix arrays of the dictionary and of the parse give each suffix two
    ranks, that of its rest of the phrase and that of the parse after it.
    Returns ``pick`` in lexicographic order of the suffixes.
    """
    m = len(data)
    text = _view(data, off)
    row = np.repeat(np.arange(text.n), np.diff(off))
    stop = off[1:][row]
    cut = np.zeros(m, bool)
    cut[off[:-1][np.diff(off) > 0]] = True
    if m >= trigger:
        at = np.arange(m - trigger + 1)
        hit = (text.hashes(at, at + trigger) % np.uint64(every) == 0) & (at + trigger <= stop[at])
        cut[at[hit]] = True
    begin = np.flatnonzero(cut)
    following = np.append(begin[1:], m)
    # A phrase runs to the end of the next trigger, or of its text.
    end = np.where(following < stop[begin], following + trigger, stop[begin])
    length = end - begin
    # Dictionary: one copy of each distinct phrase; at a text's end it differs from one that goes on.
    final = following >= stop[begin]
    key = mix(text.hashes(begin, end) + final.astype(np.uint64))
    _, copy, phrase = np.unique(key, return_index=True, return_inverse=True)
    d_len = length[copy]
    d_off = np.concatenate(([0], np.cumsum(d_len + 1)))
    total = int(d_off[-1])
    entry = np.repeat(np.arange(len(copy)), d_len + 1)
    within = np.arange(total) - d_off[entry]
    symbol = np.zeros(total + 7, np.int64)
    real = within < d_len[entry]
    symbol[:total][real] = data[begin[copy][entry[real]] + within[real]].astype(np.int64) + 2
    # The last place is a terminator: 0 at a text's end, 1 where the parse goes on.
    symbol[:total][~real] = np.where(final[copy], 0, 1)
    left = d_len[entry] + 1 - within
    packed = np.zeros(total, np.int64)
    for j in range(7):
        packed = packed * 512 + np.where(left > j, symbol[j : j + total], 0)
    _, rank = np.unique(packed, return_inverse=True)
    rank = _doubled(rank, 7, left, int(d_len.max(initial=0)) + 1)
    # Parse: phrases by dictionary order, suffixes of each text's sequence.
    p_row = row[begin]
    p_cut = np.searchsorted(p_row, np.arange(text.n + 1))
    p_left = p_cut[1:][p_row] - np.arange(len(begin))
    parse = _doubled(rank[d_off[:-1]][phrase], 1, p_left, int(p_left.max(initial=0)))
    owner = np.searchsorted(begin, pick, "right") - 1
    rest = rank[d_off[:-1][phrase[owner]] + (pick - begin[owner])]
    after = np.where(final[owner], 0, np.append(parse, 0)[owner + 1] + 1)
    return pick[np.lexsort((after, rest))]


def equal_windows(data: np.ndarray, ordered: np.ndarray, width: int = WINDOW, step: int = 20_000) -> np.ndarray:
    """True where a window's bytes equal those of the one before it in the order."""
    out = np.zeros(len(ordered), bool)
    span = np.arange(width)
    for k in range(1, len(ordered), step):
        at = ordered[k - 1 : k + step]
        grid = data[at[:, None] + span]
        out[k : k + step] = (grid[1:] == grid[:-1]).all(axis=1)
    return out


def repeats_among(data: np.ndarray, off: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, window start) of the windows of these entries that also start earlier."""
    entry = np.repeat(np.arange(len(doc)), count)
    within = np.arange(len(entry)) - np.concatenate(([0], np.cumsum(count)))[entry]
    pick = off[:-1][entry] + within
    ordered = suffix_order(data, off, pick)
    group = np.cumsum(~equal_windows(data, ordered))
    place = np.empty(len(data), np.int64)
    place[pick] = np.arange(len(pick))
    back = place[ordered]
    d, p = doc[entry][back], (start[entry] + within)[back]
    order, _, later = _first_of([group], d, p)
    return d[order][later], p[order][later]


def ordered_groups(data: np.ndarray, off: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray, level: int = 1, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Repeats (doc, start, windows) among entries of one key, a bounded number of bytes at a time.

    Passes end between keys. The entries of a key that alone are more than a
    pass are parsed by a further trigger, equal parts are one, and the rest is
    ordered part by part.
    """
    limit = limit or PASS_BYTES
    by = np.argsort(key, kind="stable")
    size = np.cumsum(count[by] + WINDOW - 1)
    edge = np.append(np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1])), len(by))
    k = 0
    while k < len(edge) - 1:
        begin = size[edge[k] - 1] if edge[k] else 0
        stop = max(k + 1, int(np.searchsorted(size[edge[1:] - 1], begin + limit, "right")))
        at = by[edge[k] : edge[stop]]
        k = stop
        total = int((count[at] + WINDOW - 1).sum())
        body = np.concatenate([data[off[i] : off[i + 1]] for i in at])
        cut = np.concatenate(([0], np.cumsum(count[at] + WINDOW - 1)))
        if total <= limit or level >= REACH - 1 or len(at) == 1:
            d, p = repeats_among(body, cut, doc[at], start[at], count[at])
            yield d, p, np.ones(len(d), np.int64)
            continue
        again, parts = _parts(body, cut, doc[at], start[at], level)
        yield again
        entry, offset, n, hashed = parts
        spans = [body[a : a + c + WINDOW - 1] for a, c in zip(cut[entry] + offset, n, strict=True)]
        yield from ordered_groups(np.concatenate(spans), np.concatenate(([0], np.cumsum(n + WINDOW - 1))), doc[at][entry], start[at][entry] + offset, n, hashed, level + 1, limit)


def _parts(data: np.ndarray, off: np.ndarray, doc: np.ndarray, start: np.ndarray, level: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """((doc, start, windows) of parts that equal an earlier one, (entry, offset, windows, trigger) of the others) of entries."""
    entry, offset, n, hashed, content = finer(data, off, level)
    d, p = doc[entry], start[entry] + offset
    order, head, later = _first_of([hashed, content], d, p)
    again, first = order[later], order[head]
    return (d[again], p[again], n[again]), (entry[first], offset[first], n[first], hashed[first])


# ------------------------------------------------------------ Spark operators


def _parse_phase(docs: DataFrame, buckets: int, hot_entries: int, batch_bytes: int) -> DataFrame:
    """Repeats and open phrases, dealt by document."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            doc, start, count, gram, content = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, head, later = _first_of([gram, content], doc, start)
            again = order[later]
            rows = list(_by_home(_REPEATS, buckets, *_ranges(doc[again], start[again], count[again])))
            first = np.sort(order[head])
            bucket = (gram[first] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in range(buckets):
                at = first[by[cut[b] : cut[b + 1]]]
                if len(at):
                    rows.append({"kind": _PHRASES, "bucket": b, "blob": pack(gram[at], content[at], doc[at], start[at].astype(np.int32), count[at].astype(np.int16))})
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist(rows[k : k + 64], _SCHEMA)

        for batch in batches:
            for part in chunks(batch, limit=PASS_BYTES):
                text = Text(part.column(1))
                ids = part.column(0).fill_null(NULL_ID).to_numpy()
                row, start, count, gram, content = phrases(text)
                held.append((ids[row], start, count, gram, content))
                size += len(text.data)
                if size >= batch_bytes:
                    yield from emit()
                    size = 0
        if held:
            yield from emit()

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        bucket = None

        def decided() -> Iterator[pa.RecordBatch]:
            if held:
                gram, content, doc, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                start, count = start.astype(np.int64), count.astype(np.int64)
                order, head, later = _first_of([gram, content], doc, start)
                again, first = order[later], order[head]
                rows = list(_by_home(_REPEATS, buckets, *_ranges(doc[again], start[again], count[again])))
                g = gram[first]
                edge = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                entries = np.repeat(np.diff(np.append(edge, len(g))), np.diff(np.append(edge, len(g))))
                open_at = first[entries > 1]
                hot = entries[entries > 1] > hot_entries
                rows += _by_home(_OPEN, buckets, doc[open_at], start[open_at], count[open_at], gram[open_at], hot)
                for k in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 64], _SCHEMA)

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] != _PHRASES:
                    yield pa.RecordBatch.from_pylist([row], _SCHEMA)
                    continue
                if row["bucket"] != bucket:
                    yield from decided()
                    bucket = row["bucket"]
                held.append(unpack(row["blob"], np.uint64, np.uint64, np.int64, np.int32, np.int16))
        yield from decided()

    blobs = docs.mapInArrow(lean(parse), _BLOB)
    # Repeats (kind above phrases) pass through; they may lie in any partition.
    return materialize(blobs.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(lean(lookup), _BLOB))


def _packed_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts as compressed blobs, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=BATCH_BYTES):
                ids = part.column(0).fill_null(NULL_ID).to_numpy()
                data, off = flat(part.column(1))
                home = _home(ids, buckets)
                order = np.argsort(home, kind="stable")
                cut = np.searchsorted(home[order], np.arange(buckets + 1))
                packer = zstandard.ZstdCompressor(level=3)
                for b in range(buckets):
                    at = order[cut[b] : cut[b + 1]]
                    if len(at):
                        body = b"".join(data[off[i] : off[i + 1]].tobytes() for i in at)
                        blob = packer.compress(np.int64(len(at)).tobytes() + ids[at].tobytes() + (off[at + 1] - off[at]).astype(np.int64).tobytes() + body)
                        yield pa.RecordBatch.from_pylist([{"kind": _TEXTS, "bucket": b, "blob": blob}], _SCHEMA)

    return docs.mapInArrow(run, _BLOB)


def _texts_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, bytes) of a blob of texts."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids = np.frombuffer(raw, np.int64, n, 8)
    off = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.int64, n, 8 + 8 * n))))
    return ids, off, np.frombuffer(raw, np.uint8, offset=8 + 16 * n)


def _sorted_by_doc(held: list[list[np.ndarray]], kinds: tuple[type, ...]) -> list[np.ndarray]:
    arrays = [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, k) for k in kinds]
    order = np.argsort(arrays[0], kind="stable")
    return [a[order] for a in arrays]


def _by_bucket(batches: Iterator[pa.RecordBatch], first: dict[int, tuple[type, ...]]) -> Iterator[tuple[dict[int, list[np.ndarray]], Iterator[bytes]]]:
    """For each bucket: the arrays of the kinds in ``first`` (which sort before texts), then its blobs of texts one by one."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    row = next(rows, None)
    while row is not None:
        bucket = row[1]
        held: dict[int, list] = {k: [] for k in first}
        while row is not None and row[1] == bucket and row[0] in first:
            held[row[0]].append(unpack(row[2], *first[row[0]]))
            row = next(rows, None)

        def texts(bucket: int = bucket) -> Iterator[bytes]:
            nonlocal row
            while row is not None and row[1] == bucket:
                blob, row = row[2], next(rows, None)
                yield blob

        rest = texts()
        yield {k: _sorted_by_doc(v, first[k]) for k, v in held.items()}, rest
        for _ in rest:
            pass


_OPEN_KINDS = (np.int64, np.int64, np.int64, np.uint64, np.bool_)
_RANGE_KINDS = (np.int64, np.int64, np.int64)


def _order_phase(parsed: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """Repeats among the open phrases, dealt by document."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, blobs in _by_bucket(batches, {_OPEN: _OPEN_KINDS}):
            doc, start, count, gram, hot = held[_OPEN]
            for blob in blobs:
                ids, off, data = _texts_of(blob)
                lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
                n = hi - lo
                which = np.repeat(np.arange(len(ids)), n)
                at = np.arange(len(which)) - np.concatenate(([0], np.cumsum(n)))[which] + lo[which]
                fits = start[at] + count[at] + WINDOW - 1 <= (off[1:] - off[:-1])[which]
                which, at = which[fits], at[fits]
                begin, size = off[which] + start[at], count[at] + WINDOW - 1
                for k in range(0, 2 * bool(len(at))):
                    # Entries of a trigger that very many have go on in parts.
                    mine = np.flatnonzero(hot[at] == bool(k))
                    if not len(mine):
                        continue
                    d, p, c, g, where = doc[at[mine]], start[at[mine]], count[at[mine]], gram[at[mine]], begin[mine]
                    if k:
                        body = np.concatenate([data[x : x + y] for x, y in zip(where, size[mine], strict=True)])
                        cut = np.concatenate(([0], np.cumsum(size[mine])))
                        # Parts of different first triggers are not compared: both make the key.
                        again, (entry, offset, c, hashed) = _parts(body, cut, d, p, 1)
                        yield from _listed(_by_home(_REPEATS, buckets, *_ranges(*again)))
                        d, p, g, where = d[entry], p[entry] + offset, mix(g[entry] + hashed * np.uint64(3)), where[entry] + offset
                    yield from _dealt(data, where, d, p, c, g, np.full(len(d), 1 + k))

    def _listed(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        held = list(rows)
        for k in range(0, len(held), 64):
            yield pa.RecordBatch.from_pylist(held[k : k + 64], _SCHEMA)

    def _dealt(data, begin, doc, start, count, gram, level) -> Iterator[pa.RecordBatch]:
        """Entries with their bytes, dealt by trigger."""
        target = (gram % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(target, kind="stable")
        cut = np.searchsorted(target[by], np.arange(buckets + 1))
        packer = zstandard.ZstdCompressor(level=3)
        for b in range(buckets):
            mine = by[cut[b] : cut[b + 1]]
            if len(mine):
                body = b"".join(data[s : s + k + WINDOW - 1].tobytes() for s, k in zip(begin[mine], count[mine], strict=True))
                head = b"".join([np.int64(len(mine)).tobytes(), *(x[mine].astype(np.int64, copy=False).tobytes() for x in (doc, start, count)), gram[mine].tobytes(), level[mine].astype(np.int64).tobytes()])
                yield pa.RecordBatch.from_pylist([{"kind": _ENTRIES, "bucket": b, "blob": packer.compress(head + body)}], _SCHEMA)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        bucket = None

        def found() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            heads, bodies = [], []
            for blob in parts:
                raw = zstandard.ZstdDecompressor().decompress(blob)
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                heads.append(np.frombuffer(raw, np.int64, 5 * n, 8).reshape(5, n))
                bodies.append(np.frombuffer(raw, np.uint8, offset=8 + 40 * n))
            parts.clear()
            doc, start, count, gram, level = np.concatenate(heads, axis=1)
            data = np.concatenate(bodies)
            off = np.concatenate(([0], np.cumsum(count + WINDOW - 1)))
            for deep in (1, 2):
                at = np.flatnonzero(level == deep)
                if len(at):
                    # One level's entries are all of the bucket as a rule; a view of the others stands where it lies.
                    body = data if len(at) == len(doc) else np.concatenate([data[off[i] : off[i + 1]] for i in at])
                    cut = np.concatenate(([0], np.cumsum(count[at] + WINDOW - 1)))
                    repeats = [x for x in ordered_groups(body, cut, doc[at], start[at], count[at], gram[at], deep) if len(x[0])]
                    if repeats:
                        yield from _listed(_by_home(_REPEATS, buckets, *_ranges(*(np.concatenate(x) for x in zip(*repeats, strict=True)))))

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == _REPEATS:
                    yield pa.RecordBatch.from_pylist([row], _SCHEMA)
                    continue
                if row["bucket"] != bucket:
                    yield from found()
                    bucket = row["bucket"]
                parts.append(row["blob"])
        yield from found()

    dealt = parsed.filter(F.col("kind") == _OPEN).unionByName(texts).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(lean(entries), _BLOB).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(lean(order), _BLOB)


_RESULT = "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"
_RESULT_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
)


def remove_repeats(docs: DataFrame, hot_entries: int = HOT_ENTRIES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, removed (byte spans) and kept (the other bytes) of every document.

    Texts are UTF-8 bytes (null: empty). A byte goes if some 100 bytes around
    it, within its text, also start earlier: in a smaller doc_id, or before in
    the same one. Null ids come before all others. Rows of one id stand at the
    same place, so neither is earlier for being another row; if their texts
    differ, a repeat found at a place of one counts for the other where it
    fits. Further columns are ignored; an empty table gives no rows.
    """
    buckets = bucket_count(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parsed = _parse_phase(rows, buckets, hot_entries, batch_bytes)
    texts = _packed_texts(rows, buckets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, blobs in _by_bucket(batches, {_REPEATS: _RANGE_KINDS}):
            doc, start, count = held[_REPEATS]

            def results(doc=doc, start=start, count=count, blobs=blobs) -> Iterator[dict]:
                for blob in blobs:
                    ids, off, data = _texts_of(blob)
                    lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
                    for i in range(len(ids)):
                        body = data[off[i] : off[i + 1]]
                        s, e = start[lo[i] : hi[i]], (start + count)[lo[i] : hi[i]] + WINDOW - 1 if hi[i] > lo[i] else start[:0]
                        fits = e <= len(body)
                        s, e = s[fits], e[fits]
                        spans = []
                        if len(s):
                            by = np.argsort(s, kind="stable")
                            s, e = s[by], np.maximum.accumulate(e[by])
                            fresh = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                            ends = np.append(e[fresh[1:] - 1], e[-1])
                            spans = list(zip(s[fresh].tolist(), ends.tolist(), strict=True))
                        keep, at = [], 0
                        for a, b in spans:
                            keep.append(body[at:a])
                            at = b
                        keep.append(body[at:])
                        yield {"doc_id": None if ids[i] == NULL_ID else int(ids[i]), "n_bytes": len(body), "removed": [{"start": a, "end": b} for a, b in spans], "kept": b"".join(x.tobytes() for x in keep)}

            yield from record_batches(results(), _RESULT_SCHEMA, 500)

    repeats = parsed.filter(F.col("kind") == _REPEATS).unionByName(_order_phase(parsed, texts, buckets))
    return repeats.unionByName(texts).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(cut, _RESULT)


def op6_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings removed from all documents."""
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
