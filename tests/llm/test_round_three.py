"""Centroid clustering, benchmark decontamination and periodic runs against brute force and odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexigrove.llm import centroids, decontamination, periodic_runs
from lexigrove.llm.common import Text

# ------------------------------------------------------------------ centroids


def full_search(vectors, ids, k=8, rounds=10):
    """Lloyd's rounds in Python integers."""
    x = [tuple(int(np.floor(1024 * float(c))) for c in v) for v in vectors]
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"3:{ids[i]}".encode()).hexdigest(), vectors[i]))
    c = [x[i] for i in order[:k]]
    near = lambda v: min((sum((p - q) ** 2 for p, q in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        a = [near(v)[1] for v in x]
        for j in range(len(c)):
            mine = [v for v, b in zip(x, a) if b == j]
            if mine:
                c[j] = tuple(sum(col) // len(mine) for col in zip(*mine))
    return [near(v)[::-1] for v in x], c


def embeddings(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance string")


def test_centroids_equal_full_search(spark):
    rng = random.Random(3)
    middle = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.3))) for c in middle[i % 5]]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]
    got = {r["vec_id"]: r for r in centroids.cluster(embeddings(spark, rows), block=64).collect()}
    want, c = full_search([v for _, v in rows], [i for i, _ in rows])
    assert {i: (got[i]["cluster"], got[i]["distance"]) for i, _ in rows} == {i: w for (i, _), w in zip(rows, want)}
    for (i, _), (j, _d) in zip(rows, want):
        assert got[i]["cluster_inertia"] == sum(d for b, d in want if b == j) and got[i]["inertia"] == sum(d for _, d in want)
        assert got[i]["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()


def test_exponion_spares_scans_and_keeps_ties():
    rng = np.random.default_rng(4)
    # A small lattice: equal distances are the rule.
    x = rng.integers(-3, 4, (3000, 4)).astype(np.int64) + 40 * rng.integers(0, 2, (3000, 1))
    now = centroids.Centroids(tuple(map(tuple, x[:9].tolist())), None)
    counts, a, u, low, full = {}, None, None, None, 0
    for _ in range(8):
        a, u, low = centroids.search(x, 50, now, a, u, low, counts)
        d = centroids.distances(x, now.array(np.int64))
        assert (a == d.argmin(axis=1)).all()
        assert (u * u * (1 + 1e-6) >= d[np.arange(len(x)), a]).all()
        d[np.arange(len(x)), a] = 1 << 40
        assert (np.maximum(low, 0) ** 2 * (1 - 1e-6) <= d.min(axis=1)).all()
        full += len(x) * 9
        totals = np.array([[int((a == j).sum()), 0, *x[a == j].sum(axis=0)] for j in range(9)], dtype=object)
        now = centroids._moved_to(totals, now)
    assert counts["scanned"] < 0.6 * full


def test_centroids_odd_rows(spark):
    ok = [0.5] * 64
    bad = [None, [], ok[:63], [*ok, 0.5], [None, *ok[1:]], [float("nan"), *ok[1:]], [float("inf"), *ok[1:]]]
    rows = [(i, v) for i, v in enumerate(bad)] + [(None, ok), (20, ok), (20, ok), (21, [-0.0001] * 64), (22, [1e300, *ok[1:]])]
    out = centroids.cluster(embeddings(spark, rows, "double")).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in out) == [(False, 20), (False, 20), (False, 21), (False, 22), (True, 0)]
    assert all(0 <= r["distance"] <= centroids.LONG and r["inertia"] >= r["cluster_inertia"] for r in out)
    assert len({(r["cluster"], r["distance"]) for r in out if r["vec_id"] in (None, 20)}) == 1
    none = centroids.cluster(embeddings(spark, rows[:7], "double"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# ------------------------------------------------------------ decontamination


def words_of(text):
    out = [""]
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) >= 128:
            out[-1] += c
        else:
            out.append("")
    return [w for w in out if w]


def plain_decontamination(docs, items, window=10):
    out = []
    for key, text in docs:
        w, hit, named = words_of(text), set(), set()
        for item, t in items:
            v = words_of(t)
            n = min(window, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[s : s + n]:
                        hit.update(range(i, i + n))
                        named.add("null" if item is None else str(item))
        out.append((key, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leaks():
    rng = random.Random(8)
    vocabulary = ["The", "of", "été", "x9", "Run", "7", "und", "zz"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(2, prose(14)), (10, prose(10)), (3, prose(25)), (4, "Two words"), (5, "été"), (6, None), (7, " .,;"), (None, prose(12)), (3, prose(11)), (2, items_text := prose(30))]
    docs = [(0, None), (1, ""), (2, "..."), (3, items_text), (4, prose(9)), (5, "two, WORDS two-words"), (6, f"{prose(5)} {items[0][1].upper()}! {prose(3)}")]
    docs += [(7, f"{items[1][1]} {items[1][1]}"), (8, " ".join(items_text.split()[:9])), (None, items_text), (3, items_text), (9, "\n".join([items[2][1], items[7][1]]) + prose(4000))]
    docs += [(20 + i, prose(rng.randint(1, 300))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_bytes": 60, "piece_windows": 3}, {"shingle": 1}, {"shingle": 10}])
def test_decontamination_equals_plain(spark, options):
    docs, items = leaks()
    d = spark.createDataFrame([(i, t, "a", 5) for i, t in docs], "doc_id long, text string, items string, n_hit int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontamination.decontaminate(d, b, **options)
    rows = sorted((tuple(r)[:6] for r in got.collect()), key=repr)
    assert rows == plain_decontamination(docs, items)
    assert all(r["items"] == sorted(r["items"]) and len(r["items"]) == r["n_items"] for r in got.collect())


def test_decontamination_empty(spark):
    docs, items = leaks()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.decontaminate(d.limit(0), b).count() == 0
    clean = decontamination.decontaminate(d, b.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] or r["n_hit"] or r["n_items"] for r in clean)


def test_prefix_is_the_rarest_shingle():
    block = decontamination.Block(["1"], ["a b c d e f g h i j k"], 10, 3)
    h, _ = block._shingles(3)
    seen = {3: {int(k): 9 for k in h.view(np.int64)}}
    seen[3][int(h.view(np.int64)[4])] = 1
    block.index(seen)
    prefix, window, place = block.prefixes[3]
    assert prefix.tolist() == [int(h[4])] * 2 and place.tolist() == [4, 3] and window.tolist() == [0, 1]
    del seen[3][int(h.view(np.int64)[5])]
    block.index(seen)
    assert not len(block.prefixes[3][0]), "a window with a shingle that stands nowhere is no candidate"


# ---------------------------------------------------------------- periodicity


def plain_runs(w, min_length=24, exponent=3):
    found = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] == w[i + p]:
                j = i
                while j + p < len(w) and w[j] == w[j + p]:
                    j += 1
                if j + p - i >= max(min_length, exponent * p):
                    found.setdefault((i, j + p), p)
                i = j
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def words(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.7:
            out += [rng.choice("abc") for _ in range(rng.randint(1, 12))] * rng.randint(1, 8)
        else:
            out += [rng.choice(["d", "é", "ff"]) for _ in range(rng.randint(1, 40))]
        if out and rng.random() < 0.3:
            out += out[: rng.randint(1, len(out))]
    return out


@pytest.mark.parametrize("min_length", [5, 9, 24])
def test_runs_equal_plain(min_length):
    rng = random.Random(min_length)
    for _ in range(60):
        docs = [words(rng) for _ in range(5)]
        text = Text(pa.array(["\n ".join(d) for d in docs]))
        found = periodic_runs.chunk_runs(text, *text.words(), min_length)
        got = [[] for _ in docs]
        for r, *run in zip(found.row.tolist(), found.start.tolist(), found.length.tolist(), found.period.tolist()):
            got[r].append(tuple(run))
        assert got == [plain_runs(d, min_length) for d in docs]


def test_grid_blocks_do_not_show(monkeypatch):
    rng = random.Random(2)
    text = Text(pa.array([" ".join(words(rng)) for _ in range(40)]))
    whole = periodic_runs.chunk_runs(text, *text.words())
    monkeypatch.setattr(periodic_runs, "GRID_BLOCK", 50)
    parts = periodic_runs.chunk_runs(text, *text.words())
    assert all((getattr(whole, k) == getattr(parts, k)).all() for k in ("row", "start", "length", "period")) and len(whole.row)


def plain_row(key, text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    h = zlib.crc32(str("null" if key is None else key).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(runs), *four, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_query_rows(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(words(rng))) for i in range(150)] + [(200, None), (201, ""), (202, " \n\t "), (203, "a " * 5000), (None, "b c " * 40), (7, "x y\n" * 30), (7, "x y\n" * 30)]
    docs += [(300 + i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 400)))) for i in range(60)]
    d = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, start string, runs int")
    got = periodic_runs.collapse_runs(d, order=periodic_runs.planted, with_text=False)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_row(*r) for r in docs), key=repr)
    assert periodic_runs.collapse_runs(d.limit(0)).count() == 0
    told = {r["doc_id"]: r for r in periodic_runs.collapse_runs(d).collect()}
    assert told[203]["collapsed"] == "a" and told[203]["runs"][0].asDict() == {"start": 0, "length": 5000, "period": 1} and told[201]["collapsed"] == ""
