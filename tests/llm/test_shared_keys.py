"""Large components of chance keys are searched by the keys that members share."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import ngram_join
from tests.llm.test_operators import brute_components

rng = random.Random(7)
NOTE = [f"licence{i}" for i in range(14)]


def chained() -> list[tuple[int, str]]:
    """Texts of their own that share a note, and copies of some with a few words changed."""
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(4_000)}" for _ in range(rng.randrange(20, 60))]
        at = rng.randrange(len(words))
        rows.append((i, " ".join(words[:at] + NOTE + words[at:])))
    for k in range(40):
        words = rows[rng.randrange(60)][1].split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("n,p,q", [(5, 4, 5), (2, 1, 2)])
@pytest.mark.parametrize("by_keys", [True, False])
def test_large_components_go_by_keys(spark, monkeypatch, by_keys, n, p, q):
    rows = chained()
    if by_keys:
        monkeypatch.setattr(ngram_join, "KEY_ROWS", 1_000_000)
        monkeypatch.setattr(ngram_join, "_in_blocks", lambda *a: pytest.fail("texts are copied to pairs of blocks"))
    else:
        monkeypatch.setattr(ngram_join, "KEY_ROWS", -1)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found, _ = ngram_join.link_components(frame, n, p, q, batch_bytes=2_000, block=3)
    root = {r["id"]: r["root"] for r in found.collect()}
    assert {i: root.get(i, i) for i, _ in rows} == {i: r for i, (_, r) in brute_components(rows, n, p, q).items()}


def test_sketches_rule_out_no_link():
    t = ngram_join.Threshold(4, 5)
    g = np.random.Generator(np.random.PCG64(3))
    sets = []
    for size in (3, 40, 300, 1_030, 5_000):
        base = g.integers(0, 2**64, size, dtype=np.uint64)
        for lost in (0, size // 30, size // 10, size // 3):
            sets.append(np.unique(np.concatenate((base[lost:], g.integers(0, 2**64, lost // 2, dtype=np.uint64)))))
    sizes = np.array([len(s) for s in sets])
    made = [ngram_join.count_vector(s, ngram_join.sketch_dimensions(len(s))).astype(np.uint32) for s in sets]
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if ngram_join.links(sets[i], sets[j], t)}
    for copies in (1, 3):  # few sets are compared all with all, more of them by a tree
        close = set()
        for a, b in ngram_join.close_pairs(np.tile(sizes, copies), np.arange(len(sets) * copies), made * copies, t):
            close |= {(min(i, j), max(i, j)) for i, j in zip((a % len(sets)).tolist(), (b % len(sets)).tolist(), strict=True)}
        assert linked and linked <= close and len({p for p in close if p[0] != p[1]}) < len(sets) * (len(sets) - 1) // 2


def test_small_components_go_by_keys_too(spark, monkeypatch):
    """The rule hangs on no size, so the rows under keys grow as the corpus does; keys of the same members count once."""
    rows, seen = chained(), {}
    by_keys, searched = ngram_join._by_keys, ngram_join._searched

    def keys(shared, *a):
        seen["keys"] = [frozenset(r["ids"]) for r in shared.groupBy("key").agg(F.collect_list("id").alias("ids")).collect()]
        return by_keys(shared, *a)

    def whole(members, *a):
        seen["whole"] = members.count()
        return searched(members, *a)

    monkeypatch.setattr(ngram_join, "KEY_ROWS", 1_000_000)
    monkeypatch.setattr(ngram_join, "_by_keys", keys)
    monkeypatch.setattr(ngram_join, "_searched", whole)
    found, _ = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5, batch_bytes=2_000)
    root = {r["id"]: r["root"] for r in found.collect()}
    assert {i: root.get(i, i) for i, _ in rows} == {i: r for i, (_, r) in brute_components(rows, 5, 4, 5).items()}
    assert seen["whole"] == 0 and seen["keys"] and len(seen["keys"]) == len(set(seen["keys"]))


def test_groups_of_the_same_nodes_are_one():
    key = np.array([9, 9, 9, 4, 4, 4, 4, 7, 7, 5, 5, 5, 5], np.uint64)
    node = np.array([1, 2, -3, 2, -3, 1, 1, 1, 2, 1, 2, 3, 4], np.int64)
    group, ids = ngram_join.groups_of(key, node)
    sets = {frozenset(ids[group == g].tolist()) for g in np.unique(group)}
    assert sets == {frozenset({1, 2, -3}), frozenset({1, 2, 3, 4})} and len(ids) == 7
    assert not len(ngram_join.groups_of(key[:0], node[:0])[0])
