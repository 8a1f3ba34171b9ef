"""Document fingerprints: a quartile bucket digest.

Byte triplets of a text (three shapes within a window of four bytes) are
hashed into 256 buckets. The digest has two bits a bucket, the quartile of its
count among all buckets, and a byte for the length on a logarithmic scale.
Two digests are compared by a difference score: the summed distances between
quartiles (opposite ends count double) plus a capped length term, bounded by a
constant, so 1 - score / bound is a likeness from 0 to 1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.common import materialize, read_table

BUCKETS = 256
#: Offsets of the second and third byte of a triplet.
SHAPES = ((1, 2), (1, 3), (2, 3))
#: Distance of two quartiles: adjacent ones 1, the two ends 6.
_STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int64)
LENGTH_CAP = 64
BOUND = 6 * BUCKETS + LENGTH_CAP


def digest(data: bytes) -> bytes:
    """Digest of a text's bytes: one of length, then two bits for each bucket.

    Under three bytes there is no triplet: all quartiles are 0.
    """
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for i, (p, q) in enumerate(SHAPES):
        m = len(b) - q
        if m > 0:
            h = (b[:m] * np.uint32(0x9E3779B1) + b[p : p + m] * np.uint32(0x85EBCA6B) + b[q : q + m] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F * i & 0xFFFFFFFF)) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    ranked = np.sort(counts)
    q1, q2, q3 = ranked[BUCKETS // 4 - 1], ranked[BUCKETS // 2 - 1], ranked[3 * BUCKETS // 4 - 1]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    four = code.reshape(-1, 4)
    body = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    length = min(255, round(8 * math.log2(len(data) + 1)))
    return bytes([length]) + body.astype(np.uint8).tobytes()


def _codes(d: bytes) -> np.ndarray:
    body = np.frombuffer(d, np.uint8)[1:]
    return np.stack([body & 3, body >> 2 & 3, body >> 4 & 3, body >> 6], axis=1).ravel()


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 for the largest difference."""
    score = int(_STEP[_codes(a), _codes(b)].sum()) + min(LENGTH_CAP, abs(a[0] - b[0]))
    return 1.0 - score / BOUND


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "pid long, role string, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_SCHEMA = pa.schema(
    [("pid", pa.int64()), ("role", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())]
)


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _compared(pid: int, doc_id: int | None, text: str, d: bytes, following: str, following_d: bytes) -> dict:
    changed = _bytes(edited(text, following))
    e = digest(changed)
    return dict(pid=pid, role="done", doc_id=doc_id, n_chars=len(text), edited_sha256=hashlib.sha256(changed).hexdigest(), fingerprint=d.hex(),
                edited_fingerprint=e.hex(), near_edited=likeness(d, e), near_next=likeness(d, following_d), text=None)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)


def _emit(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["text"] or "") + 800
        if size > 4_000_000:
            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _SCHEMA)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edit by the next document's start.

    Documents are dealt by ranges of ``doc_id`` and read in order as a stream;
    a text crosses the network once. Where a range ends, the next document
    begins another: those last and first rows (two a range) are joined in a
    second step that streams over them.

    Null texts are empty; null ids come first and are kept; rows of one id go
    by text; the last row's next is the first; a single row is its own next; an
    empty table gives no rows; further columns are ignored.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()

        def rows() -> Iterator[dict]:
            before = None
            for doc_id, text in _rows(batches):
                text = text or ""
                d = digest(_bytes(text))
                if before is None:
                    yield dict.fromkeys(_SCHEMA.names) | dict(pid=pid, role="first", text=text)
                else:
                    yield _compared(pid, *before, text, d)
                before = (doc_id, text, d)
            if before:
                yield dict.fromkeys(_SCHEMA.names) | dict(pid=pid, role="last", doc_id=before[0], text=before[1])

        return _emit(rows())

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            start = waiting = None
            for pid, role, doc_id, text in _rows(batches):
                d = digest(_bytes(text))
                if role == "last":
                    waiting = (pid, doc_id, text, d)
                elif waiting:
                    yield _compared(*waiting, text, d)
                start = start or (text, d)
            if waiting:
                yield _compared(*waiting, *start)

        return _emit(rows())

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = materialize(ordered.mapInArrow(within, _OUT))
    ends = made.filter("role <> 'done'").select("pid", "role", "doc_id", "text").coalesce(1).sortWithinPartitions("pid", "role")
    kept = [c for c in _SCHEMA.names if c not in ("pid", "role", "text")]
    return made.filter("role = 'done'").select(*kept).unionByName(ends.mapInArrow(across, _OUT).select(*kept))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile digests of all documents, of their edits, and their likeness."""
    return compare_with_next(read_table(spark, sf_dir, "documents"))
