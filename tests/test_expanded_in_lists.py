"""Expansions are told by groups of nodes and unfolded in the last step; only the first nodes of a text are scored."""

import random

from lexigrove.operators import bm25, graph, joins


def _graph(spark, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["A", "B", "C", None]), rng.choice(["f", "g", "A", None]), rng.choice(["class", "method"]), i) for i in range(60)]
    calls = [(rng.randrange(60), rng.choice(["f", "g", "A", "none"]), rng.randrange(5)) for _ in range(120)]
    seeds = [(q, i, r + 1) for q in range(8) for r, i in enumerate(rng.sample(range(60), 3))]
    frames = (
        spark.createDataFrame(seeds, "query_id long, id long, rank int"),
        spark.createDataFrame(rows, "id long, class string, name string, type string, pos int"),
        spark.createDataFrame(calls, "id long, callee string, pos int"),
    )
    return (seeds, rows, calls), frames


def _expected(seeds, rows, calls):
    node = {r[0]: r for r in rows}
    best = {}
    for q, s, rank in seeds:
        _, c, f, t, _ = node[s]
        wanted = f if t == "class" else c
        hits = [(i, (rank, 0, 0, pos)) for i, cls, _, _, pos in rows if wanted is not None and cls == wanted]
        hits += [(i, (rank, 1, at, pos)) for caller, callee, at in calls if caller == s for i, _, name, _, pos in rows if name == callee]
        for i, way in hits:
            if (q, i) not in {(x, y) for x, y, _ in seeds}:
                best[q, i] = min(best.get((q, i), way), way)
    return best


def test_groups_lead_to_what_nodes_lead_to(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIST", 2)
    plain, frames = _graph(spark)
    best = _expected(*plain)
    got = graph.expand(*frames).collect()
    assert len(got) == len(best) and {(r["query_id"], r["id"]): (r["seed_rank"], r["prio"], r["call_pos"], r["pos"]) for r in got} == best
    listed = graph.expand_listed(*frames).collect()
    flat = [(r["query_id"], i, r["relation"], r["seed_rank"]) for r in listed for i in r["ids"]]
    assert sorted(flat) == sorted((q, i, "calls" if w[1] else "same_class", w[0]) for (q, i), w in best.items())


def test_product_of_lists(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIST", 2)
    left = spark.createDataFrame([(1, "a", [1, 2, 3]), (1, "b", [4]), (2, "a", [5]), (3, "a", [6]), (2, "c", [])], "key long, kind string, x array<int>")
    right = spark.createDataFrame([(1, v) for v in range(40)] + [(2, 7), (4, 8)], "key long, v long")
    got = sorted(tuple(r) for r in joins.product_of_lists(left, right, "key", "x", "v").select("v", "kind", "x").collect())
    assert got == sorted([(v, k, x) for v in range(40) for k, x in (("a", 1), ("a", 2), ("a", 3), ("b", 4))] + [(7, "a", 5)])
    assert joins.product_of_lists(left.limit(0), right, "key", "x", "v").count() == 0


def test_first_nodes_of_a_text_are_enough(spark):
    texts = ["red ring", "red bolt", "old ring", None, "", "red red ring"]
    nodes = spark.createDataFrame([(i, texts[i % 6]) for i in range(50)], "id long, text string")
    queries = spark.createDataFrame([(1, "red"), (2, "ring bolt"), (3, "old"), (4, "nothing")], "query_id long, text string")
    rows = lambda index: {tuple(r) for r in bm25.retrieve(index, queries, 3).select("query_id", "id", "score", "rank").collect()}
    index = bm25.build_of_texts(nodes, 3)
    assert rows(index) == rows(bm25.build(nodes)) and index.lengths.count() == 15


def test_the_square_is_neither_sorted_nor_shuffled(spark):
    from lexigrove.plans import registry

    plan = registry.queries()["a97_expand"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Both sides are unfolded above the last join: nothing but projections follows.
    after = plan[: plan.index("SortMergeJoin")]
    assert "Window" not in plan and after.count("Generate explode") == 2 and "Exchange" not in after
