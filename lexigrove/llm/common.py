"""Shared helpers of the training-data operators.

Texts travel to Python as Arrow batches and are processed as flat byte
arrays, so the work of a batch is a handful of numpy passes whatever the
number of documents in it.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that are handled in one numpy pass (a longer text is one pass).
CHUNK_BYTES = 1_000_000

#: Word pattern shared by all operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15 | 1)
_K_INV = np.uint64(pow(int(_K), -1, 2**64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers of 0 to n - 1."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


@lru_cache(maxsize=1)
def _chunk_powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse for a chunk, made once a worker."""
    return _powers(_K, CHUNK_BYTES + 1), _powers(_K_INV, CHUNK_BYTES + 1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    ``spark.checkpoint.dir`` where the session names one; only without it
    (tests on one machine) a local temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexigrove-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written to the shared folder and read back, and a call that deletes it.

    Cuts the lineage, so later steps survive lost executors without
    recomputing what went before. All of an application's steps lie in one
    folder named by its id, to be deleted when its results are stored.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)

    def drop() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), drop


def materialize(df: DataFrame) -> DataFrame:
    """The table of :func:`written`."""
    return written(df)[0]


#: Keys that hold more than this part of all rows are salted; as many at most.
HOT_KEYS = 1_000


def join_salted(big: DataFrame, small: DataFrame, keys: list[str], weight: str, how: str, deal: Column) -> DataFrame:
    """``big`` joined with ``small``, whose rows are unique by ``keys``.

    ``weight`` is a column of ``small``: about how many rows of ``big`` have the
    key. Keys with over a thousandth of the total are cut into as many parts as
    they hold thousandths, dealt by a hash of ``deal``. At most ``HOT_KEYS``
    keys can be that heavy, so their broadcast is bounded at any size. ``small`` should be
    a table that is already written: it is read three times.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    parts = F.ceil(F.col(weight) * F.lit(float(HOT_KEYS)) / F.lit(float(max(total, 1)))).cast("int")
    hot = small.filter(parts > 1).select(*keys, parts.alias("__parts"))
    salted = big.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(deal), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return salted.join(spread.hint("merge"), [*keys, "__salt"], how).drop("__salt")


#: Bytes of input that a bucket of a deal stands for.
BUCKET_BYTES = 8_000_000


def bucket_count(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets to deal rows into: as many as the planner's estimate of the input's bytes asks for, whatever the session's partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # A plan without statistics claims a size beyond any table.
    return least if size > 1 << 60 else max(least, -(-size // bucket_bytes))


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """Schema of ``df`` followed by the fields of ``ddl``."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(30))
    h = h * M1
    h = h ^ (h >> np.uint64(27))
    h = h * M2
    return h ^ (h >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text each; every row is in one."""
    column = batch.column(batch.schema.get_field_index(text))
    _, off = flat(column)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


class Text:
    """Byte-level view of a chunk of texts: code points, words, lines and hashes."""

    def __init__(self, column: pa.Array):
        self.data, self.off = flat(column)
        self.n = len(self.off) - 1
        self._sums = None

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Count of set flags (one per byte) in each row."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.off[1:]] - total[self.off[:-1]]

    def code_points(self) -> np.ndarray:
        return (self.data & 0xC0) != 0x80

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of ``inside`` bytes that do not cross rows: start, end, row."""
        m = len(self.data)
        if m == 0:
            z = np.zeros(0, np.int64)
            return z, z, z
        first = np.zeros(m + 1, dtype=bool)
        first[self.off] = True
        before = np.empty(m, dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | first[:m]))
        after = np.empty(m, dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | first[1:])) + 1
        return start, end, np.searchsorted(self.off, start, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (without the line feed) and row of every line; each row has at least one."""
        cut = np.flatnonzero(self.data == 10)
        row_of = np.searchsorted(self.off, cut, "right") - 1
        start = np.concatenate((self.off[:-1], cut + 1))
        row = np.concatenate((np.arange(self.n), row_of))
        order = np.lexsort((start, row))
        start, row = start[order], row[order]
        end = np.empty_like(start)
        if len(start):
            last = np.append(row[1:] != row[:-1], True)
            end[:-1] = start[1:] - 1
            end[last] = self.off[1:][row[last]]
        return start, end, row

    def hashes(self, start: np.ndarray, end: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte spans, a function of their bytes alone."""
        if self._sums is None or data is not None:
            d = self.data if data is None else data
            powers, inverse = _chunk_powers() if len(d) <= CHUNK_BYTES else (_powers(_K, len(d)), _powers(_K_INV, len(d) + 1))
            sums = np.zeros(len(d) + 1, dtype=np.uint64)
            np.cumsum(_TABLE[d] * powers[: len(d)], out=sums[1:])
            made = (sums, inverse)
            if data is None:
                self._sums = made
        else:
            made = self._sums
        sums, inverse = made
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * M2)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def sequences(units: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive unit hashes from each position of ``first``."""
    h = mix(units[first] + np.uint64(n))
    for j in range(1, n):
        h = mix(h * _K + units[first + j])
    return h


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with its worker's free memory given back at the end: workers live on, and the next stage needs the room."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def record_batches(rows: Iterable[dict], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded number of rows."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as a compressed blob, so a shuffle moves few large rows."""
    raw = b"".join([np.int64(len(arrays[0])).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    """Inverse of :func:`pack`; ``kinds`` are the arrays' element types."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out
