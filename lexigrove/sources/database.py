"""SQLite databases as tables: read in parallel by key ranges with pushed filters, and databases that are rows themselves.

:func:`read_database` reads one database file that every executor sees. Its
reader takes the comparisons of a query's WHERE clause into SQLite's own, and
splits the rest by ranges of a whole-number column, one task each.

:func:`databases` packs each partition of a table into a database of its own, a
row with its image; :func:`query_databases` runs SQL on each where it lies. A
folder of database files in any store is read the same way
(:func:`database_files`). No rows pass through the driver.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class KeyRange(InputPartition):
    """Keys from ``low`` up to, not with, ``high``; None is open, and ``nulls`` takes rows without a key too."""

    low: int | None
    high: int | None
    nulls: bool = False


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")`` with options ``path``, ``query``, and for a parallel read ``key`` and ``partitions``; and a schema."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("state a schema: SQLite columns have no fixed types")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.query, self.key, self.n = options["path"], options["query"], options.get("key"), int(options.get("partitions", 1))
        self.columns, self.kinds = schema.names, {f.name: f.dataType.typeName() for f in schema.fields}
        self.where: list[str] = []
        self.values: list[object] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take comparisons of numbers and texts; the others are left to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            plain = column in self.kinds and self.kinds[column] in ("byte", "short", "integer", "long", "double", "string")
            if plain and type(f) in _COMPARE and isinstance(f.value, (int, float, str)) and f.value == f.value:
                self.where.append(f"{quoted(column)} {_COMPARE[type(f)]} ?")
                self.values.append(f.value)
            elif plain and isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.where.append(f"{quoted(column)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif plain and isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{quoted(column)} IS {'' if isinstance(f, IsNull) else 'NOT '}NULL")
            else:
                yield f

    def statement(self, part: KeyRange | None = None, what: str | None = None) -> tuple[str, list[object]]:
        """SQL and its values for one range of keys."""
        where, values = list(self.where), list(self.values)
        if part is not None and self.key:
            bounds = [f"{quoted(self.key)} {op} ?" for op, v in ((">=", part.low), ("<", part.high)) if v is not None]
            values += [v for v in (part.low, part.high) if v is not None]
            inside = " AND ".join(bounds) or "1"
            where.append(f"({inside} OR {quoted(self.key)} IS NULL)" if part.nulls else f"({inside})" if bounds else f"{quoted(self.key)} IS NOT NULL")
        what = what or ", ".join(map(quoted, self.columns))
        return f"SELECT {what} FROM ({self.query})" + (f" WHERE {' AND '.join(where)}" if where else ""), values

    def partitions(self) -> list[InputPartition]:
        if not self.key or self.n < 2:
            return [KeyRange(None, None, True)]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(*self.statement(what=f"min({quoted(self.key)}), max({quoted(self.key)})")).fetchone()
        if low is None:
            return [KeyRange(None, None, True)]
        cuts = sorted({low + (high + 1 - low) * i // self.n for i in range(1, self.n)} - {low})
        edges = [None, *cuts, None]
        return [KeyRange(a, b, i == 0) for i, (a, b) in enumerate(zip(edges, edges[1:]))]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        c = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from c.execute(*self.statement(partition))
        finally:
            c.close()


def read_database(spark: SparkSession, query: str, schema: str, path: str, key: str | None = None, partitions: int = 1) -> DataFrame:
    """Rows of a query on a database file that all executors see.

    ``key``, a whole-number column of the query, splits the read into up to
    ``partitions`` ranges; rows without a key are in the first. Comparisons that
    are later made with the rows run in the database.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").schema(schema).option("query", query).option("path", path)
    return (reader.option("key", key).option("partitions", partitions) if key else reader).load()


# ------------------------------------------------------------ databases as rows

#: SQLite's type for each of Arrow's.
_AFFINITY = ((pa.types.is_integer, "INTEGER"), (pa.types.is_boolean, "INTEGER"), (pa.types.is_floating, "REAL"), (pa.types.is_binary, "BLOB"))


def databases(rows: DataFrame, table: str) -> DataFrame:
    """(image): one database for each partition of the rows, all in its table ``table``; columns are numbers, texts, booleans or bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sqlite3.connect(":memory:")
        made = False
        for batch in batches:
            if not made:
                kinds = (next((a for test, a in _AFFINITY if test(f.type)), "TEXT") for f in batch.schema)
                c.execute(f"CREATE TABLE {quoted(table)} ({', '.join(f'{quoted(f.name)} {k}' for f, k in zip(batch.schema, kinds))})")
                made = True
            c.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * batch.num_columns)})", zip(*(col.to_pylist() for col in batch.columns)))
        c.commit()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([c.serialize()], pa.binary())], names=["image"])
        c.close()

    return rows.mapInArrow(run, "image binary")


def database_files(spark: SparkSession, folder: str, glob: str = "*.sqlite") -> DataFrame:
    """(image) of every database file of a folder, from any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select(F.col("content").alias("image"))


def query_databases(images: DataFrame, query: str, schema: str) -> DataFrame:
    """Rows of a query on each of many databases, run where the image is; a database without the table is an error."""
    kinds = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for batch in batches:
            for image in batch.column(0).to_pylist():
                c = sqlite3.connect(":memory:")
                c.deserialize(image)
                found = c.execute(query)
                while held := found.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(col).cast(f.type) for col, f in zip(zip(*held), arrow)], schema=arrow)
                c.close()

    return images.select("image").mapInArrow(run, schema)
