"""Running aggregates over hot keys, and orders of trees, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import evaluation, frames, graph, temporal
from lexigrove.operators.joins import skew_join
from lexigrove.operators.scans import Parts


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Keep adaptive execution from putting these few rows into one part."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark, n=4_000):
    """One key holds nine tenths of the rows; null keys, null values and ties of order."""
    rng = random.Random(7)
    out = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.randint(0, n // 2), i, rng.choice([None, 1, 2, 5])) for i in range(n)]
    return out, spark.createDataFrame(out, "k string, x long, i int, v int")


def test_running_equals_loop(spark):
    plain, df = rows(spark)
    parts = Parts(df, ["k"], ["x", "i"])
    # A hot key is spread over all tasks.
    spread = [r["n"] for r in parts.rows.filter("k = 'hot'").groupBy("__part").agg(F.count("*").alias("n")).collect()]
    assert len(spread) >= 7 and max(spread) < 3 * sorted(spread)[len(spread) // 2]
    got = {r["i"]: tuple(r)[4:] for r in parts.running(s=("sum", F.col("v")), lo=("min", F.col("v")), hi=("max", F.col("v")), last=("last", F.col("v")), next=("next", F.col("v"))).collect()}
    groups = {}
    for k, x, i, v in sorted(plain, key=lambda r: (r[1], r[2])):
        groups.setdefault(k, []).append((i, v))
    for each in groups.values():
        seen = []
        for at, (i, v) in enumerate(each):
            seen += [] if v is None else [v]
            after = next((w for _, w in each[at:] if w is not None), None)
            assert got[i] == ((sum(seen), min(seen), max(seen), seen[-1]) if seen else (None,) * 4) + (after,)


def test_rolling_equals_loop(spark):
    plain, df = rows(spark, 1_500)
    for span in (1, 40, 5_000):
        got = {r["i"]: (r["n"], r["s"]) for r in Parts(df, ["k"], ["x"]).rolling(span, n=F.count("*"), s=F.sum("v")).collect()}
        assert len(got) == len(plain)
        for k, x, i, _ in plain:
            hit = [w for q, y, _, w in plain if q == k and x - span < y <= x]
            known = [w for w in hit if w is not None]
            assert got[i] == (len(hit), sum(known) if known else None)
    assert Parts(df.limit(0), ["k"], ["x"]).rolling(5, n=F.count("*")).count() == 0


@pytest.mark.parametrize("strategy", ["backward", "forward", "nearest"])
def test_asof_with_one_hot_key(spark, strategy):
    rng = random.Random(5)
    make = lambda n: [(i, "hot" if rng.random() < 0.95 else "b", rng.randint(0, 3_000)) for i in range(n)]
    left, right = make(800), make(300)
    right = list({(k, s): (i, k, s) for i, k, s in right}.values())
    frame = lambda data, name: spark.createDataFrame(data, f"{name} int, k string, s long").select(name, "k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    got = {r["id"]: r["price"] for r in temporal.join_asof(frame(left, "id"), frame(right, "price"), "ts", "k", ["price"], strategy).collect()}
    for i, k, s in left:
        before, after = ([(abs(t - s), p) for p, q, t in right if q == k and (t <= s if d else t >= s)] for d in (True, False))
        b, a = min(before, default=None), min(after, default=None)
        want = {"backward": b, "forward": a, "nearest": b if a is None or b is not None and b[0] <= a[0] else a}[strategy]
        assert got[i] == (want and want[1])


def test_numbers_and_categories(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("x"), F.concat(F.lit("c"), (F.col("id") % 40).cast("string")).alias("c"))
    side = frames.concat_horizontal(df.select("x"), df.select(F.col("x").alias("y")).filter("y < 100"), "x", "y").collect()
    assert sorted((r["x"], r["y"]) for r in side if r["y"] is not None) == [(i, i) for i in range(100)] and len(side) == 500
    codes = {r["c"]: r["code"] for r in frames.categories(df, "c", "code").collect()}
    assert codes == {c: i for i, c in enumerate(sorted(codes))}


def test_skew_join(spark):
    """Half of the rows have one key: same pairs as a plain join, and no task with over three times the median."""
    left = spark.range(40_000).select(F.col("id").alias("l"), F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 97 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("name"))
    right = spark.createDataFrame([(i, k) for i, k in enumerate(["hot", "hot", "k1", "k3", "k5", None, "none"])], "r int, callee string")
    got = skew_join(left, right, ["name"], ["callee"])
    want = left.join(right, left["name"] == right["callee"])
    assert sorted((r["l"], r["r"]) for r in got.collect()) == sorted((r["l"], r["r"]) for r in want.collect())
    every = spark.createDataFrame([(1, "hot"), *((i, f"k{i}") for i in range(400))], "r int, callee string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per_task = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        dealt, plain = per_task(skew_join(left, every, ["name"], ["callee"])), per_task(left.join(every, left["name"] == every["callee"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert max(dealt) <= 3 * sorted(dealt)[len(dealt) // 2] and max(plain) > 3 * sorted(plain)[len(plain) // 2]
    assert skew_join(left.limit(0), right, ["name"], ["callee"]).count() == 0
    same = skew_join(left.select("name"), right.select(F.col("callee").alias("name"), "r"), ["name"])
    assert same.columns == ["name", "r"] and same.count() == want.count()


def walk(edges, start):
    """Least depths below a node."""
    depth, at = {start: 0}, [start]
    for v in at:
        for w in edges.get(v, ()):
            if w not in depth:
                depth[w] = depth[v] + 1
                at.append(w)
    return {k: d for k, d in depth.items() if k != start}


@pytest.mark.parametrize("shape", ["tree", "dag", "loops"])
def test_descendants_equal_walk(spark, shape):
    rng = random.Random(shape)
    names = [f"v{i:03}" for i in range(240)]
    pairs = {(names[rng.randrange(max(0, i - rng.choice([3, 200])), i)], names[i]) for i in range(1, 200)}
    if shape != "tree":
        pairs |= {tuple(sorted(rng.sample(names[:200], 2))) for _ in range(60)}
    if shape == "loops":
        pairs |= {tuple(rng.sample(names[:200], 2)) for _ in range(10)} | {("v210", "v211"), ("v211", "v212"), ("v212", "v210"), ("v212", "v213"), ("v005", "v210"), ("v220", "v220")}
    kids = {}
    for p, c in pairs:
        kids.setdefault(p, []).append(c)
    starts = ["v000", "v001", "v050", "v199", "v211", "v220", "v230"]
    got = graph.descendants(spark.createDataFrame(sorted(pairs), "parent string, child string"), spark.createDataFrame([(s,) for s in starts], "id string"))
    assert {(r["start"], r["id"]): r["depth"] for r in got.collect()} == {(s, v): d for s in starts for v, d in walk(kids, s).items()}


def test_tree_order(spark):
    rng = random.Random(9)
    parent = {f"v{i:03}": f"v{rng.randrange(i):03}" if i % 40 else None for i in range(300)} | {"lost": "nowhere", "lost2": "lost", "x": "y", "y": "x", "z": "x"}
    got = {r["id"]: r for r in graph.tree_order(spark.createDataFrame(list(parent.items()), "id string, parent_id string")).collect()}
    kids = {}
    for v, p in sorted(parent.items()):
        kids.setdefault(p, []).append(v)

    def visit(v, root, depth, at):
        first = at
        at += 1
        for c in kids.get(v, ()):
            at = visit(c, root, depth + 1, at)
        assert tuple(got[v])[1:] == (root, first, at - first, depth)
        return at

    n = sum(visit(r, r, 0, 0) for r in kids[None])
    assert n == len(got) == 300


def test_shifted_equals_loop(spark):
    """Rows before and after, over parts, one key with most rows, null keys, pieces shorter than the step."""
    plain, df = rows(spark, 1_200)
    groups = {}
    for k, x, i, v in sorted(plain, key=lambda r: (r[1], r[2])):
        groups.setdefault(k, []).append((i, v))
    for n, m in ((1, -1), (3, 2), (-2, -5), (700, -700)):
        got = {r["i"]: (r["w"], r["j"]) for r in Parts(df, ["k"], ["x", "i"]).shifted(w=(n, F.col("v")), j=(m, F.col("i"))).collect()}
        assert len(got) == len(plain)
        for each in groups.values():
            for at, (i, _) in enumerate(each):
                w = each[at - n][1] if 0 <= at - n < len(each) else None
                assert got[i] == (w, each[at - m][0] if 0 <= at - m < len(each) else None)
    assert Parts(df.limit(0), ["k"], ["x", "i"]).shifted(w=(1, F.col("v"))).count() == 0


def test_diff_product_and_rank_of_a_hot_key(spark):
    plain, df = rows(spark, 1_500)
    by_diff = {r["i"]: r["d"] for r in frames.diff(df, "x", ["k"], ["x", "i"], "d").collect()}
    by_prod = {r["i"]: r["p"] for r in frames.cum_prod(df.withColumn("v", F.when(F.col("v") == 5, 0.5).otherwise(F.col("v"))), "v", ["k"], ["x", "i"], "p").collect()}
    ranks = {r["i"]: r["m"] for r in frames.average_rank(df, "v", ["k"], "m").collect()}
    means = {r["i"]: (r["n"], r["s"]) for r in frames.over(df, ["k"], n=F.count("*"), s=F.sum("v")).collect()}
    groups = {}
    for row in sorted(plain, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    for each in groups.values():
        product, last = 1.0, None
        low = lambda v: -1 if v is None else v
        for _, x, i, v in each:
            product *= {None: 1.0, 5: 0.5}.get(v, v)
            assert by_diff[i] == (None if last is None else x - last) and by_prod[i] == product
            less, same = sum(low(r[3]) < low(v) for r in each), sum(r[3] == v for r in each)
            assert ranks[i] == less + (same + 1) / 2
            assert means[i] == (len(each), sum(r[3] or 0 for r in each))
            last = x


def test_median_of_counts(spark):
    rng = random.Random(9)
    plain = [(rng.choice(["a", None]), rng.random() < 0.9, rng.choice([None, 3, 4, 7, 7, 9])) for _ in range(400)] + [("one", True, 5), ("two", True, 5), ("two", True, 6), ("none", True, None)]
    got = {(r["condition"], r["is_correct"]): tuple(r)[2:] for r in evaluation.token_stats(spark.createDataFrame(plain, "condition string, is_correct boolean, token_count int")).collect()}
    groups = {}
    for condition, right, n in plain:
        groups.setdefault((condition, right), []).append(n)
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        known = [v for v in values if v is not None]
        ordered = sorted(values, key=lambda v: -1 if v is None else v)
        n, mean, median = got[key]
        assert n == len(values) and median == ordered[len(values) // 2] and (mean == pytest.approx(sum(known) / len(known)) if known else mean is None)
