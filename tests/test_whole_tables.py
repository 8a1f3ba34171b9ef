"""Queries over whole tables that have no SQL, against brute force."""

from math import comb

from pyspark.sql import functions as F

from lexigrove.operators import bm25, evaluation, graph, similarity
from lexigrove.plans import registry

SF = "/root/testdata/sf0.001"


def test_sign_flip_all(spark):
    t = registry.Tables(spark, SF)
    deltas = [r["toxic"] - r["quality"] for r in t.labels.collect()]
    m, net = sum(map(abs, deltas)), sum(deltas)
    got = registry.queries()["a143_sign_flip"](spark, SF).first()
    want = sum(comb(m, i) for i in range(m + 1) if abs(2 * i - m) >= abs(net)) / 2**m
    assert (got["m"], got["net"]) == (m, net) and abs(got["p_value"] - want) < 1e-6


def test_sign_flip_of_many_pairs(spark):
    """Linear in the pairs: 200,000 of them, two standard deviations from even."""
    row = evaluation.sign_flip(spark.range(200_000).selectExpr("IF(id < 100447, 1, -1) AS delta")).first()
    assert (row["m"], row["net"]) == (200_000, 894) and 0.045 < row["p_value"] < 0.046


def test_all_queries_are_answered(spark):
    """Every item, part and nation has its rows."""
    t, q = registry.Tables(spark, SF), registry.queries()
    rows = lambda name: {tuple(r) for r in q[name](spark, SF).collect()}
    items = {r["item_id"] for r in t.benchmark.collect()}
    parts = {r["p_partkey"] for r in t.part.collect()}
    for name, asked in (("a87_bm25_scores", items), ("a91_irrelevant", items), ("a99_provenance", parts)):
        assert {r[0] for r in rows(name)} == asked
    assert rows("b49_read_database") == {(r["n_nationkey"], r["n_name"]) for r in t.nation.collect()}


def test_deep_chains(spark):
    """A chain of a thousand nodes, a cycle that a tail leads to, a child that two parents list."""
    chain = [("c0", None), *((f"c{i}", f"c{i - 1}") for i in range(1, 1_000)), ("x0", "x2"), ("x1", "x0"), ("x2", "x1"), *((f"t{i}", f"t{i - 1}" if i else "x0") for i in range(200))]
    nodes = spark.createDataFrame([(i, p, i, "d") for i, p in chain], "id string, parent_id string, title string, definition string")
    assert {r["id"] for r in graph.cycles(nodes).collect()} == {"x0", "x1", "x2"}
    assert graph.cycles(nodes.filter("id like 'c%'")).count() == 0
    edges = nodes.filter("id like 'c%' and parent_id is not null").select(F.col("parent_id").alias("parent"), F.col("id").alias("child"))
    twice = edges.unionByName(spark.createDataFrame([("c0", "c500"), ("c9", "gone")], "parent string, child string"))
    kept = graph.children(twice.withColumn("pos", F.lit(0)), nodes)
    below = {r["id"]: r["depth"] for r in graph.descendants(kept, spark.createDataFrame([("c0",)], "id string")).collect()}
    assert len(below) == 999 and below["c499"] == 499 and below["c500"] == 1 and below["c999"] == 500
    near = graph.descendants(kept, spark.createDataFrame([("c0",)], "id string"), 2)
    assert {r["id"] for r in near.collect()} == {"c1", "c2", "c500", "c501"}
    lines = {r["id"]: r for r in graph.tree_lines(nodes).collect()}
    assert lines["c999"]["depth"] == 999 and lines["c999"]["line"].startswith("  " * 999 + "- c999") and lines["t5"]["line"].startswith("[orphan] ") and len(lines) == len(chain)


def test_least_relevant_against_brute_force(spark):
    """Blocks of ids that all match, and of ids that none does."""
    texts = [(i, "apple pie" if i < 9_000 and i % 4_500 else "plum" if i % 2 else "apple") for i in range(10_000)]
    docs = spark.createDataFrame(texts, "id long, text string")
    asked = spark.createDataFrame([(1, "apple pie"), (2, "plum"), (3, "none")], "query_id long, text string")
    index = bm25.build(docs)
    scored = {(r["query_id"], r["id"]): r["score"] for r in bm25.scores(index, asked).collect()}
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in bm25.least_relevant(index, asked, 4).collect()}
    for q in (1, 2, 3):
        want = sorted((scored.get((q, i), 0.0), i) for i, _ in texts)[:4]
        assert [got[q, k + 1] for k in range(4)] == [(i, s) for s, i in want]


def test_leakage_against_brute_force(spark):
    t = registry.Tables(spark, SF)
    grams = lambda text: (lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else set(w))((text or "").lower().split())
    left, right = ({r[0]: grams(r[1]) for r in df.collect()} for df in (t.documents.select("doc_id", "text"), t.benchmark.select("item_id", "text")))
    want = {(a, b, round(len(x & y) / len(x | y), 3)) for a, x in left.items() for b, y in right.items() if x & y and len(x & y) >= 0.1 * len(x | y)}
    assert {tuple(r) for r in similarity.leakage(t.documents, t.benchmark, "doc_id", "item_id", 0.1).collect()} == want
