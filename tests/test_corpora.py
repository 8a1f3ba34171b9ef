"""Snapshots, the store on them, incremental builds, and patches against git."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrove.operators.nodes import NODE_SCHEMA
from lexigrove.sources import patches as P
from lexigrove.sources import source_code as S
from lexigrove.sources.corpus import Corpus, RepeatedPath
from lexigrove.sources.snapshots import ConflictError, Snapshots
from lexigrove.sources.store import Store

# ---------------------------------------------------------------- snapshots, store


def nodes(spark, *ids, title="t"):
    rows = spark.createDataFrame([(i, title, "d") for i in ids], "id string, title string, definition string")
    for f in StructType.fromDDL(NODE_SCHEMA).fields:
        rows = rows if f.name in rows.columns else rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    return rows.select(*StructType.fromDDL(NODE_SCHEMA).names)


def ids(store):
    return sorted(r["id"] for r in store.nodes.collect())


def test_commits_are_exclusive(spark, tmp_path):
    a, b = (Snapshots(spark, str(tmp_path)) for _ in range(2))
    assert a.version() == 0 and a.entry(0) == {}
    assert a.commit(0, {"x": "first"}) == 1
    with pytest.raises(ConflictError):
        b.commit(0, {"x": "second"})
    assert b.version() == 1 and b.entry(1) == {"x": "first"} and b.commit(1, {"x": "third"}) == 2
    assert a.entry(2) == {"x": "third"}


class Stopped(Exception):
    pass


@pytest.mark.parametrize("step", ["save_nodes", "commit", "expire"])
def test_store_is_whole_after_a_stop_at_any_step(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path)
    with Store(spark, path) as s:
        s.put(nodes(spark, "a", "b"))
    s.put(nodes(spark, "c"))

    def stop(*_):
        raise Stopped

    if step == "save_nodes":
        monkeypatch.setattr("lexigrove.sources.store.save_nodes", lambda rows, at: (rows.write.json(at), stop()))
    else:
        monkeypatch.setattr(Snapshots, step, stop)
    with pytest.raises(Stopped):
        s.flush()
    monkeypatch.undo()
    again = Store(spark, path, create_if_missing=False)
    assert ids(again) == (["a", "b", "c"] if step == "expire" else ["a", "b"])
    gone = again.snapshots.vacuum()
    assert len(gone) == (0 if step == "expire" else 1) and ids(Store(spark, path)) == ids(again)
    again.put(nodes(spark, "d"))
    assert again.flush() and "d" in Store(spark, path)


def test_two_writers(spark, tmp_path):
    path = str(tmp_path)
    one, two = Store(spark, path), Store(spark, path)
    one.put(nodes(spark, "a"))
    two.put(nodes(spark, "b"))
    assert one.flush()
    with pytest.raises(ConflictError):
        two.flush()
    assert two.dirty and ids(Store(spark, path)) == ["a"]
    two.rebase()
    assert two.flush() and ids(Store(spark, path)) == ["a", "b"]
    reader = Store(spark, path)
    two.remove(nodes(spark, "a").select("id"))
    two.flush()
    assert ids(reader) == ["a", "b"], "a reader keeps the version it has opened"
    two.put(nodes(spark, "b", title="new"))
    two.flush()
    assert two.snapshots.versions() == [3, 4] and ids(two) == ["b"]


# --------------------------------------------------------------------------- builds


def files(spark, rows):
    return spark.createDataFrame(list(rows.items()), "path string, content string")


def told(corpus):
    return sorted(tuple(r)[:3] for r in corpus.rows().select("path", "qualified_name", "source").collect())


def test_incremental_equals_full(spark, tmp_path):
    rng = random.Random(4)
    source = lambda i: f"def f{i}(x):\n    return g{rng.randint(0, 99)}(x)\n" * rng.randint(0, 2)
    now = {f"m{i}.py": source(i) for i in range(30)} | {"empty.py": None, "bad.py": "def ("}
    corpus = Corpus(spark, str(tmp_path / "inc"))
    first = corpus.build(files(spark, now))
    assert (first.version, first.files, first.added, first.parsed) == (1, 32, 32, 32)
    for turn in range(5):
        before = dict(now)
        for name in rng.sample(sorted(now), 12):
            now[name] = source(turn)
        for name in rng.sample(sorted(now), 2):
            del now[name]
        now[f"new{turn}.py"] = source(7)
        counts = corpus.build(files(spark, now))
        same = lambda k: (before[k] or "") == (now[k] or "")
        changed, added = [k for k in now if k in before and not same(k)], [k for k in now if k not in before]
        assert (counts.added, counts.changed, counts.removed) == (len(added), len(changed), len(set(before) - set(now)))
        assert counts.parsed == len(added) + len(changed) and counts.files == len(now)
        full = Corpus(spark, str(tmp_path / f"full{turn}"))
        full.build(files(spark, now))
        assert told(corpus) == told(full)
        assert {r["path"] for r in corpus.tombstones().collect()} == set(before) - set(now)
    assert corpus.build(files(spark, now)).parsed == 0 and corpus.snapshots.version() == 6
    assert any(corpus.counts(v).compacted for v in corpus.snapshots.versions())
    assert corpus.rows(1).count() > 0 and corpus.manifest(1).count() == 32, "earlier versions stay readable"


def test_builds_fail_whole(spark, tmp_path):
    corpus, other = (Corpus(spark, str(tmp_path)) for _ in range(2))
    twice = files(spark, {"a.py": "x = 1"}).unionByName(files(spark, {"a.py": "y = 1"}))
    with pytest.raises(RepeatedPath):
        corpus.build(twice)
    with pytest.raises(LookupError):
        corpus.rows()
    corpus.build(files(spark, {"a.py": "def a(): pass"}))

    def slow(rows):
        # While this build parses, the other one commits.
        other.build(files(spark, {"b.py": "def b(): pass"}))
        return S.extract(rows)

    with pytest.raises(ConflictError):
        Corpus(spark, str(tmp_path), slow).build(files(spark, {"c.py": "def c(): pass"}))
    assert [r["qualified_name"] for r in corpus.rows().collect()] == ["b"]
    assert corpus.snapshots.vacuum() and [r["qualified_name"] for r in corpus.rows().collect()] == ["b"]
    assert corpus.build(spark.createDataFrame([], "path string, content string")).removed == 1 and corpus.rows().count() == 0


def test_definitions_within_functions(spark):
    rows = S.definitions("m.py", "class A:\n    def f(self):\n        class B:\n            def g(self):\n                def h(): pass\n        def k(): pass\n")
    assert [(r["kind"], r["qualified_name"], r["parent_class"], r["parent_function"]) for r in rows] == [
        ("class", "A", None, None), ("method", "A.f", "A", None), ("class", "B", None, None), ("method", "B.g", "B", None), ("sub_function", "g.h", None, "g"), ("sub_function", "f.k", None, "f"),
    ]


# -------------------------------------------------------------------------- patches


def git_applies(folder, contents, patch):
    folder.mkdir()
    for name, content in contents.items():
        at = folder / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content)
    (folder / "p.diff").write_text(patch)
    return subprocess.run(["git", "apply", "--check", "p.diff"], cwd=folder, capture_output=True, env={"GIT_CEILING_DIRECTORIES": str(folder.parent), "PATH": "/usr/bin:/bin"}).returncode == 0


def a_patch(rng, old, context):
    """A diff of an edited copy of ``old`` under the name of m.txt, sometimes spoiled."""
    import difflib

    new = list(old)
    for _ in range(rng.randint(1, 3)):
        at = rng.randint(0, len(new))
        new[at : at + rng.randint(0, 2)] = [f"{rng.choice('abxy')}\n" for _ in range(rng.randint(0, 2))]
    lines = list(difflib.unified_diff(old, new, "a/m.txt", "b/m.txt", n=context))
    if not lines:
        return ""
    out = []
    for x in lines:
        out.append(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n")
    spoil = rng.random()
    if spoil < 0.1:
        k = rng.randrange(2, len(out))
        out[k] = out[k].replace("a", "q").replace("@@ -1", "@@ -3")
    elif spoil < 0.2:
        del out[rng.randrange(2, len(out))]
    return "".join(out)


def test_patches_as_git_does(spark, tmp_path):
    rng = random.Random(11)
    contents, cases = {}, []
    for i in range(300):
        old = [f"{rng.choice('abcd')}\n" for _ in range(rng.randint(0, 14))]
        if old and rng.random() < 0.15:
            old[-1] = old[-1].rstrip("\n")
        patch = a_patch(rng, old, rng.choice([0, 1, 3]))
        now = list(old)
        if rng.random() < 0.6 and now:
            at = rng.randint(0, len(now) - 1)
            now[at:at] = [f"{rng.choice('abz')}\n" for _ in range(rng.randint(1, 3))]
        contents[f"d{i}/m.txt"] = "".join(now)
        cases.append((i, patch, "".join(now)))
    moved = [(i, p.replace("a/m.txt", f"a/d{i}/m.txt").replace("b/m.txt", f"b/d{i}/m.txt")) for i, p, _ in cases]
    got = {r["patch_id"]: r for r in P.check_patches(spark.createDataFrame(moved, "patch_id int, patch string"), spark.createDataFrame(list(contents.items()), "path string, content string")).collect()}
    want = {i: git_applies(tmp_path / str(i), {"m.txt": now}, patch) for i, patch, now in cases}
    assert {i: got[i]["applies"] for i in want} == want, {i: (got[i], cases[i]) for i in want if got[i]["applies"] != want[i]}
    assert 0.2 < sum(want.values()) / len(want) < 0.9 and sum(r["n_shifted"] for r in got.values()) > 10


def test_patch_statuses(spark):
    head = "--- a/x\n+++ b/x\n"
    content = "1\n2\n3\n4\n5\n6\n7\n8\n"
    cases = {
        "exact": (head + "@@ -2,3 +2,3 @@\n 2\n-3\n+three\n 4\n", None),
        "shifted": (head + "@@ -4,3 +4,3 @@\n 2\n-3\n+three\n 4\n", None),
        "conflict": (head + "@@ -2,3 +2,3 @@\n 2\n-9\n+three\n 4\n", "conflict"),
        "overlap": (head + "@@ -2,3 +2,3 @@\n 2\n-3\n+three\n 4\n@@ -4,2 +4,3 @@\n 4\n+x\n 5\n", "overlap"),
        "dashes": ("--- a/y\n+++ b/y\n@@ -1,3 +1,2 @@\n a\n--- b\n c\n", None),
        "short": (head + "@@ -2,3 +2,3 @@\n 2\n-3\n+three\n", "malformed"),
        "no header": ("@@ -2,3 +2,3 @@\n 2\n-3\n+three\n 4\n", "malformed"),
        "prose": ("nothing to apply\n", "malformed"),
        "empty": (" \n\n", "empty"),
        "null": (None, "empty"),
        "missing": (head.replace("x", "nowhere") + "@@ -1 +1 @@\n-a\n+b\n", "missing_file"),
        "made": ("--- /dev/null\n+++ b/z\n@@ -0,0 +1 @@\n+a\n", None),
        "there": ("--- /dev/null\n+++ b/x\n@@ -0,0 +1 @@\n+a\n", "exists"),
        "gone": ("--- a/y\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-a\n--- b\n-c\n", None),
        "left": ("--- a/x\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-1\n-2\n", "conflict"),
        "two files": (head + "@@ -2,3 +2,3 @@\n 2\n-3\n+three\n 4\n--- a/y\n+++ b/y\n@@ -1,2 +1,2 @@\n a\n--- q\n+x\n", "conflict"),
    }
    patches = spark.createDataFrame([(k, p) for k, (p, _) in cases.items()], "patch_id string, patch string")
    texts = spark.createDataFrame([("x", content), ("y", "a\n-- b\nc\n")], "path string, content string")
    got = {r["patch_id"]: r for r in P.check_patches(patches, texts).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {k: why for k, (_, why) in cases.items()}
    assert got["shifted"]["n_shifted"] == 1 and got["two files"]["n_hunks"] == 2
    assert P.check_patches(patches.limit(0), texts).count() == 0 and P.check_patches(patches, texts.limit(0)).filter("applies").count() == 2, "only what is made anew needs no file"
