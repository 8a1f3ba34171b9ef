"""The database source, the block index, and the n-gram filter."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import bm25, similarity
from lexigrove.sources import database
from lexigrove.sources.database import KeyRange, SqliteReader


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("db") / "users.sqlite")
    with sqlite3.connect(at) as c:
        c.execute("CREATE TABLE users (id INTEGER, name TEXT, score REAL)")
        c.executemany("INSERT INTO users VALUES (?, ?, ?)", [(i, f"n{i % 100}", i / 2) for i in range(100_000)] + [(None, "nobody", None)])
    return at


def test_parallel_read_with_pushed_filters(spark, path):
    rows = database.read_database(spark, "SELECT * FROM users", "id bigint, name string, score double", path, "id", 8)
    assert rows.rdd.getNumPartitions() == 8 and rows.count() == 100_001
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [12_500] * 7 + [12_501]
    some = rows.filter("name = 'n7' and score >= 40000 and id is not null and id % 200 = 7")
    assert sorted(r["id"] for r in some.collect()) == [i for i in range(80_000, 100_000) if i % 200 == 7]
    left = some._jdf.queryExecution().executedPlan().toString().split("Filter", 1)[1].split("\n")[0]
    assert "% 200" in left and "score" not in left and "name" not in left, "only what SQLite was not given is left to Spark"
    assert rows.filter("id in (3, 5, 99999)").count() == 3 and rows.filter("id is null").first()["name"] == "nobody" and rows.filter("id > 500000").count() == 0


def test_statements(path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, Not
    from pyspark.sql.types import StructType

    reader = SqliteReader({"path": path, "query": "SELECT * FROM users", "key": "id", "partitions": "4"}, StructType.fromDDL("id bigint, name string"))
    odd = Not(EqualTo(("name",), "x"))
    assert list(reader.pushFilters([EqualTo(("name",), "n'1"), GreaterThan(("id",), 99_000), odd])) == [odd]
    parts = reader.partitions()
    assert len(parts) == 1 or parts[0].nulls and not parts[1].nulls
    assert reader.statement(KeyRange(5, 9)) == ('SELECT "id", "name" FROM (SELECT * FROM users) WHERE "name" = ? AND "id" > ? AND ("id" >= ? AND "id" < ?)', ["n'1", 99_000, 5, 9])


def test_databases_as_rows(spark, tmp_path):
    rows = spark.range(1_000).select("id", F.concat(F.lit("it's "), F.col("id")).alias("t"), F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("x"), (F.col("id") % 2 == 0).alias("even"))
    held = database.databases(rows.repartition(5), "t")
    assert held.count() == 5
    got = database.query_databases(held, "SELECT id, t, x, even FROM t WHERE id < 500", "id bigint, t string, x double, even boolean")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.filter("id < 500").collect()), key=str)
    for i, image in enumerate(r["image"] for r in held.collect()):
        (tmp_path / f"{i}.sqlite").write_bytes(image)
    files = database.database_files(spark, str(tmp_path))
    assert database.query_databases(files, "SELECT count(*) FROM t", "n bigint").agg(F.sum("n")).first()[0] == 1_000
    assert database.databases(rows.limit(0), "t").count() == 0


@pytest.mark.parametrize("window_nodes", [4, 50, 100_000])
def test_block_index_equals_full_scores(spark, tmp_path, monkeypatch, window_nodes):
    monkeypatch.setattr(bm25, "FEW", 0)
    rng = random.Random(window_nodes)
    # Common words everywhere, rare ones in a few nodes, some texts without a token.
    word = lambda: rng.choice(["apple", "plum", "pear"]) if rng.random() < 0.8 else f"rare{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}"
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(600)], "id long, text string")
    asked = spark.createDataFrame([(1, "apple pear rareab raregh"), (2, "plum plum"), (3, "rarecd"), (4, "nothing here"), (5, None), (6, "rareaa rarebb rarecc raredd apple")], "query_id long, text string")
    plain = bm25.build(docs)
    index = bm25.write(plain, str(tmp_path / "index"), window_nodes)
    listed = lambda df: sorted(map(tuple, df.collect()))
    assert listed(bm25.scores(index, asked)) == listed(bm25.scores(plain, asked))
    assert listed(index.terms.select("term", "df", F.round("idf", 9))) == listed(plain.terms.select("term", "df", F.round("idf", 9)))
    for k in (1, 3, 700):
        assert listed(bm25.retrieve(index, asked, k)) == listed(bm25.retrieve(plain, asked, k))
    one = asked.filter("query_id = 6")
    assert [tuple(r) for r in bm25.retrieve_one(index, one, 5).collect()] == [tuple(r) for r in bm25.retrieve_one(plain, one, 5).collect()]
    read = {r["query_id"]: r for r in bm25.blocks_read(index, asked, 3).collect()}
    assert set(read) == {1, 2, 3, 6} and all(r["postings_read"] <= r["postings"] for r in read.values())
    if window_nodes == 4:
        assert read[6]["postings_read"] < 0.5 * read[6]["postings"], "windows of common words alone are skipped"


def test_leakage_filter(spark):
    some = spark.createDataFrame([(f"w{i}",) for i in range(3_000)], "gram string")
    asked = spark.createDataFrame([(f"w{i}",) for i in range(60_000)], "gram string")
    met = {r["gram"] for r in similarity.maybe_seen(asked, "gram", similarity.seen_filter(some, "gram")).collect()}
    assert {f"w{i}" for i in range(3_000)} <= met and len(met) < 3_000 + 0.05 * 57_000
    assert similarity.maybe_seen(asked, "gram", similarity.seen_filter(some.limit(0), "gram")).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x y"), (3, None), (4, ""), (5, "A B C D"), (6, "q r s t")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "a b c d"), (11, "y x"), (12, None)], "item_id long, text string")
    got = {(r[0], r[1]): r[2] for r in similarity.leakage(docs, items, "doc_id", "item_id", 0.3).collect()}
    assert got == {(1, 10): 0.5, (5, 10): 1.0, (2, 11): 1.0}
    assert similarity.leakage(docs, items.limit(0), "doc_id", "item_id").count() == 0
