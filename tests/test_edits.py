"""Edits of model answers, node stores, and text functions on odd inputs."""

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import text as T
from lexigrove.operators import builds, evaluation as E
from lexigrove.sources import source_code as S
from lexigrove.sources.store import Store

SOURCE = "class Box:\n    def weigh(self):\n        if self.full:\n            total = self.inner_weight()\n        return total\n"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_anchor_indentation():
    at, matched, status = S.find_anchor(SOURCE, "if self.full:\n    total = self.inner_weight()")
    assert status == "indent_corrected" and matched == "        if self.full:\n            total = self.inner_weight()" and SOURCE[at:].startswith(matched)
    # Other inner nesting is not the same block; its longest telling line stands for it.
    assert S.find_anchor(SOURCE, "if self.full:\ntotal = self.inner_weight()")[1:] == ("            total = self.inner_weight()", "fuzzy")
    assert S.find_anchor(SOURCE, "    def weigh(self):")[2] == "exact"
    assert S.find_anchor(SOURCE, "pass\n# total = self.inner_weight()")[2] == S.find_anchor(SOURCE, " \n")[2] == "not_found"


def test_fuzzy_edit_is_applied():
    diff, status = S.unified_diff("box.py", SOURCE, [("x = 1\ntotal = self.inner_weight()", "total = 0")])
    assert status == ["fuzzy"] and "+            total = 0" in diff and "-            total = self.inner_weight()" in diff


def test_edit_forms():
    fence = "```python\n"
    assert S.edit_pairs(f"BEFORE:\n{fence}a\n```\nAFTER:\n{fence}b\n```") == [("a", "b")]
    assert S.edit_pairs(f"{fence}# BEFORE\na\n# AFTER\nb\n```") == [("a", "b")]
    assert S.edit_pairs("<BEFORE>\n  a\n</BEFORE>\n<AFTER>\n  b\n</AFTER>") == [("  a", "  b")]
    whole = "def weigh(self):\n    return self.inner_weight() + 1"
    assert S.edit_pairs(f"{fence}{whole}\n```") == [("", whole)] and S.edit_pairs(f"{fence}def f(): pass\n```") == [] and S.edit_pairs(None) == []
    body = "    def weigh(self):\n        return 1"
    assert S.completed("", whole, body) == (body, "    def weigh(self):\n        return self.inner_weight() + 1")
    assert S.completed("other", whole, body) == ("other", whole) and S.completed("", whole, None) == ("", whole)


def test_store(spark, tmp_path):
    node = lambda *ids: spark.createDataFrame([(i, f"t{i}", "d") for i in ids], "id string, title string, definition string")
    from lexigrove.operators.nodes import NODE_SCHEMA
    from pyspark.sql.types import StructType

    def full(rows):
        for f in StructType.fromDDL(NODE_SCHEMA).fields:
            rows = rows if f.name in rows.columns else rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        return rows.select(*StructType.fromDDL(NODE_SCHEMA).names)

    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        Store(spark, path, create_if_missing=False)
    with Store(spark, path) as s:
        s.put(full(node("a", "b")))
    s = Store(spark, path, create_if_missing=False)
    assert len(s) == 2 and "a" in s and "c" not in s and not s.flush()
    with pytest.raises(ValueError):
        s.add(full(node("b")))
    with pytest.raises(RuntimeError), Store(spark, path) as again:
        again.remove(node("a").select("id"))
        raise RuntimeError("the block fails, nothing is written")
    assert len(Store(spark, path)) == 2


def test_balanced_json(spark):
    got = lambda x: one(spark, T.balanced_json(F.col("t")), t=x)
    assert got('{"a": {"b": [1, {"c": 2}]}}') == '{"a": {"b": [1, {"c": 2}]}}' and got('x {"a": {}} y {"b": 1}') == '{"a": {}}'
    assert got('```json\n{"a": 1}\n```') == '{"a": 1}' and got("{open") is None and got("none") is None and got(None) is None and got("") is None and got("{a b}") is None


def test_checks_and_outcomes(spark):
    with pytest.raises(KeyError, match="b"):
        builds.require_keys(spark.range(1), "id", "b")
    with pytest.raises(ValueError):
        E.normalized_dataset(spark.range(1))
    empty = spark.createDataFrame([], "topic string, concepts array<string>")
    assert builds.not_built(empty, spark.createDataFrame([], "id string")).count() == 0 and builds.hierarchy_ids(empty).count() == 0


def test_scratch_is_deleted(spark):
    from lexigrove.sources.scratch import clean, cut

    rows = cut(spark.range(3))
    assert rows.count() == 3 and clean(spark)
    with pytest.raises(Exception, match="not exist|FILE|Path"):
        rows.count()
