"""Unit tests of the engine's own operators, with expected values from their definitions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import text as T
from lexigrove.operators import bm25, evaluation, frames, fusion, graph, nodes, similarity, temporal
from lexigrove.sources import source_code, store
from lexigrove.streaming import windows

CONCEPTS = [
    ("combinatorics_root", "Combinatorics", "counting techniques overview"),
    ("binomial", "Binomial coefficient", "choose k from n objects"),
    ("permutation", "Permutation", "ordered arrangements of objects"),
    ("lattice_path", "Lattice path", "monotone grid path counting"),
    ("unrelated_geometry", "Geometry", "triangle area formula"),
]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("text,want", [("Choose 5 from 10", ["choose", "5", "from", "10"]), ("", []), ("   ", []), ("The x of \\binom", ["binom"])])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("t")), t=text) == want


@pytest.mark.parametrize("name,want", [("Raised Bed Drainage", "raised_bed_drainage"), ("pH (soil, top layer)", "ph_soil_top_layer"), ("\t early -- frost!", "early_frost"), ("a-b/c", "a_b_c")])
def test_normalize_id(spark, name, want):
    assert one(spark, T.normalize_id(F.col("t")), t=name) == want


def test_responses(spark):
    assert one(spark, T.clean_response(F.col("t")), t="<think>aĠb</think> xĠyĊ") == "x y"
    assert one(spark, T.clean_response(F.col("t")), t="a <think>q") == "a <think>q"
    assert one(spark, T.last_code_block(F.col("t")), t="```python\na\n``` ```py\nb\n``` ```python\nc\n```") == "c\n"
    assert one(spark, T.selected_ids(F.col("t")), t='```json\n{"selected_ids": ["a", 2]}\n```') == ["a", "2"]
    assert one(spark, T.selected_ids(F.col("t")), t="none") == []
    assert one(spark, T.yes_no(F.col("t")), t="well, yes or no") == "YES" and one(spark, T.yes_no(F.col("t")), t="nothing") == "NO"
    assert one(spark, T.patch_files(F.col("t")), t="diff --git a/x.py b/x.py\ndiff --git a/y.py b/y.py") == ["x.py", "y.py"]


def test_bm25(spark):
    rows = spark.createDataFrame([(i, f"{t}\n{d}") for i, t, d in CONCEPTS], "id string, text string")
    queries = spark.createDataFrame([(1, "lattice path grid monotone"), (2, "zzz")], "query_id int, text string")
    index = bm25.build(rows)
    got = bm25.retrieve(index, queries, 2).collect()
    assert got[0]["id"] == "lattice_path" and all(r["query_id"] == 1 for r in got)
    with pytest.raises(ValueError):
        bm25.retrieve(index, queries, 0)
    least = {(r["query_id"], r["id"]) for r in bm25.least_relevant(index, queries.filter("query_id = 1"), 2).collect()}
    assert least == {(1, "binomial"), (1, "combinatorics_root")}


def test_rrf(spark):
    lists = spark.createDataFrame([(1, 0, "binomial", 1), (1, 0, "permutation", 2), (1, 1, "lattice_path", 1), (1, 1, "binomial", 2)], "query_id int, list_no int, id string, rank int")
    assert [r["id"] for r in fusion.rrf(lists).orderBy("rank").collect()] == ["binomial", "lattice_path", "permutation"]


def test_self_knowledge(spark):
    rows = lambda answers: spark.createDataFrame([(1, f"n{i}", i, a) for i, a in enumerate(answers)], "query_id int, id string, rank int, answer string")
    kept = lambda answers, k=0: [r["id"] for r in fusion.self_knowledge(rows(answers), k).orderBy("rank").collect()]
    assert kept(["YES", "NO", "YES", "NO"]) == ["n1", "n3"] and kept(["YES", "YES"], 1) == ["n0"] and kept([None, None]) == ["n0", "n1"]
    assert abs(fusion.self_knowledge_stats(rows(["YES", "NO", "YES"])).first()["filter_rate"] - 2 / 3) < 1e-12


def test_localize(spark):
    cand = spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(["a", "b", "c"])], "query_id int, id string, rank int")
    got = lambda ids, k: [(r["id"], r["fell_back"]) for r in fusion.localized(cand, spark.createDataFrame([(1, ids)], "query_id int, ids array<string>"), k).orderBy("rank").collect()]
    assert got(["99", "2"], 1) == [("b", False)] and got(["ghost"], 2) == [("a", True), ("b", True)] and got(["c", "a"], 2) == [("c", False), ("a", False)]


def test_graph_expansion(spark):
    rows = [("get", "SQL", "get_order_by", "method", 0), ("init", "SQL", "__init__", "method", 1), ("setup", "SQL", "_setup", "method", 2), ("other", None, "unrelated", "function", 3)]
    n = spark.createDataFrame(rows, "id string, class string, name string, type string, pos int")
    calls = spark.createDataFrame([("get", "_setup", 0)], "id string, callee string, pos int")
    seeds = spark.createDataFrame([(1, "get", 1)], "query_id int, id string, rank int")
    near = lambda **k: {(r["id"], r["relation"]) for r in graph.expand(seeds, n, calls, **k).collect()}
    assert near() == {("init", "same_class"), ("setup", "same_class")} and near(same_class=False) == {("setup", "calls")}
    scored = spark.createDataFrame([(1, "get", 2.0)], "query_id int, id string, score double")
    assert [r["id"] for r in graph.graph_expanded(seeds, n, calls, scored, 6, 1).orderBy("rank").collect()] == ["get", "init"]


def test_validate(spark):
    n = spark.createDataFrame([("root", None), ("a", "b"), ("b", "a"), ("c", "ghost")], "id string, parent_id string")
    listed = spark.createDataFrame([("root", "nowhere"), ("root", "c"), ("a", "c")], "parent string, child string")
    got = {tuple(r) for r in graph.validate(n, listed).collect()}
    assert got == {("missing_child", "root", "nowhere"), ("missing_parent", "c", "ghost"), ("not_mutual", "root", "c"), ("not_mutual", "a", "c"), ("cycle", "a", "a"), ("cycle", "b", "b"), ("many_parents", "c", "2")}


def test_leakage(spark):
    left = spark.createDataFrame([(1, "Find the number of monotone lattice paths from origin to a given point"), (2, "Compute C(5,2) using binomial.")], "a int, text string")
    right = spark.createDataFrame([(1, "Find the number of monotone lattice paths from origin to point with coordinates"), (2, "Find all triangles in a graph.")], "b int, text string")
    assert [(r["a"], r["b"]) for r in similarity.leakage(left, right, "a", "b", 0.3).collect()] == [(1, 1)]


def test_fuzzy(spark):
    ids = spark.createDataFrame([("polynomial_roots_and_coefficients",), ("factoring_techniques",), ("vietas_formulas",)], "id string")
    refs = spark.createDataFrame([("polynomial_roots",), ("xyz_completely_unrelated",)], "ref string")
    got = similarity.fuzzy_match(refs, ids).collect()
    assert [(r["ref"], r["id"]) for r in got if r["place"] == 1] == [("polynomial_roots", "polynomial_roots_and_coefficients")]


def test_repair(spark):
    refs = spark.createDataFrame([("v", 0, "ok"), ("v", 1, "okay"), ("v", 2, "v"), ("v", 3, "zzz")], "id string, pos int, ref string")
    ids = spark.createDataFrame([("ok",), ("okays",), ("v",), ("target",)], "id string")
    judged = spark.createDataFrame([("zzz", "target"), ("okay", "nope")], "ref string, answer string")
    r = similarity.repair_references(refs, ids, judged).first()
    assert (r["related"], r["by_match"], r["by_judge"]) == (["ok", "okays", "target"], ["okay"], ["zzz"])


def test_frames(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "id int, x int")
    b = spark.createDataFrame([(1, 1.5), (1, 2.5)], "id int, x double")
    with pytest.raises(frames.NotUnique):
        frames.join(a, b, ["id"], validate="1:1")
    assert frames.join(a, b, ["id"], how="left").columns == ["id", "x", "x_right"]
    with pytest.raises(frames.SchemaMismatch):
        frames.concat([a, b])
    assert frames.concat([a, b], "vertical_relaxed").dtypes == [("id", "int"), ("x", "double")]
    assert frames.concat([a, b.withColumnRenamed("x", "y")], "diagonal_relaxed").columns == ["id", "x", "y"]
    assert one(spark, frames.replace_first(F.col("t"), "a", "Z"), t="banana") == "bZnana"
    with pytest.raises(frames.NotUnique):
        frames.pivot(spark.createDataFrame([("x", "p", 1), ("x", "p", 2)], "a string, b string, v int"), "a", "b", "v", ["p"])


def test_rolling_and_asof(spark):
    day = lambda n, h=0, m=0: dt.datetime(2025, 1, n, h, m)
    rows = spark.createDataFrame([(1, day(1), 10), (1, day(2), 20), (1, day(3), 30)], "k int, ts timestamp_ntz, v int")
    assert [r["s"] for r in temporal.rolling(rows, "ts", "2d", {"s": F.sum("v")}, ("k",)).orderBy("ts").collect()] == [10, 30, 50]
    trades = spark.createDataFrame([(1, day(1, 10, 5)), (1, day(1, 10, 30))], "k int, ts timestamp_ntz")
    quotes = spark.createDataFrame([(1, day(1, 10, 0), 100.0), (1, day(1, 10, 15), 99.0), (1, day(1, 10, 25), 101.0)], "k int, ts timestamp_ntz, price double")
    price = lambda *a: [r["price"] for r in temporal.join_asof(trades, quotes, "ts", "k", ["price"], *a).orderBy("ts").collect()]
    assert price() == [100.0, 101.0] and price("forward") == [99.0, None] and price("nearest") == [100.0, 101.0] and price("backward", "4m") == [None, None]


def test_evaluation(spark):
    pairs = spark.createDataFrame([(i, d) for i, d in enumerate([1, 1, 1, 0, -1])], "sample_id int, delta int")
    row = evaluation.sign_flip(pairs).first()
    assert (row["m"], row["net"]) == (4, 2) and abs(row["p_value"] - 0.625) < 1e-9
    runs = [(1, "b", False, "x", "ok"), (1, "r", True, "y", "ok"), (2, "b", False, "x", "ok"), (2, "r", False, "x", "ok"), (3, "b", True, "x", "ok"), (3, "r", False, "", "ok")]
    got = {r["sample_id"]: r["category"] for r in evaluation.triage(spark.createDataFrame(runs, "sample_id int, condition string, is_correct boolean, pred_answer string, status string"), "b").collect()}
    assert got == {1: "rag_saved", 2: "consistent_wrong", 3: "baseline_correct_only"}
    b = evaluation.bootstrap(pairs, 1000).first()
    assert -1 <= b["low"] <= 0.4 <= b["high"] <= 1


GARDEN = """class Bed(Plot):
    rows = 4

    async def water(self, litres, *, slow=False):
        '''Water every row.'''
        for row in self.plants():
            await row.soak(split(litres, self.rows))


def harvest(beds):
    def ripe(bed):
        return bed.age() > LIMIT

    return list(filter(ripe, beds))
"""


def test_definitions(spark):
    df = spark.createDataFrame([("plots/bed.py", GARDEN), ("broken.py", "class (:")], "path string, content string")
    rows = source_code.extract(df).orderBy("path", "pos").collect()
    assert [(r["kind"], r["qualified_name"]) for r in rows] == [("rejected", None), ("class", "Bed"), ("method", "Bed.water"), ("function", "harvest"), ("sub_function", "harvest.ripe")]
    water, harvest = rows[2], rows[3]
    assert water["docstring"] == "Water every row." and (water["start_line"], water["end_line"]) == (4, 7) and water["params"] == ["self", "litres", "slow"]
    assert water["calls"] == ["plants", "soak", "split"] and harvest["calls"] == ["age", "list", "filter"] and harvest["start_line"] == 10


def test_anchors(spark):
    src = "class A:\n    def f(self):\n        x = 1\n        return x\n"
    assert source_code.find_anchor(src, "        x = 1")[2] == "exact" and source_code.find_anchor(src, "nothing here at all")[2] == "not_found"
    assert source_code.find_anchor(src, "x = 1\nreturn x")[1:] == ("        x = 1\n        return x", "indent_corrected")
    answers = spark.createDataFrame([("a.py", "<<<<<<< SEARCH\nx = 1\n=======\nx = 2\n>>>>>>> REPLACE")], "path string, answer string")
    r = source_code.diffs(answers, spark.createDataFrame([("a.py", src)], "path string, content string")).first()
    assert "-        x = 1\n+        x = 2" in r["diff"] and r["statuses"] == ["indent_corrected"]
    assert source_code.doctests(">>> 1 + 1\n2\n\n>>> x = [\n...   1]\n") == [{"code": "1 + 1", "output": "2"}, {"code": "x = [\n  1]", "output": ""}]
    assert source_code.sections("Sum.\n\nParameters\n----------\nx : int")["parameters"] == "x : int"


def test_store(spark, tmp_path):
    path = tmp_path / "tree.json"
    path.write_text('{"version": "0.1.0", "nodes": [{"id": "good", "title": "t", "definition": "d"}, {"id": "bad", "title": ""}, {"id": "good", "title": "t2", "definition": "d"}]}')
    valid, rejected = store.load_nodes(spark, str(path))
    assert [(r["id"], r["title"], r["confidence"], r["source"]) for r in valid.collect()] == [("good", "t2", 1.0, "manual")] and rejected.count() == 1
    assert one(spark, nodes.invalid_reason(), id="a", title=" ", definition="d", confidence=0.5) == "title"
    path.write_text('{"version": "0.1.0"}')
    with pytest.raises(ValueError):
        store.load_nodes(spark, str(path))


def test_stream(spark, tmp_path):
    rows = [(dt.datetime(2025, 1, 1, h), 1.0) for h in range(24)] + [(dt.datetime(2025, 1, 3), 1.0)]
    spark.createDataFrame(rows, "ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = windows.to_parquet(windows.windowed(stream, "ts", [F.sum("v").alias("s")], "6 hours"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(r["s"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [6.0] * 4
