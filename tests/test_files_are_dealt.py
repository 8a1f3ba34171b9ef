from lexigrove.plans import code
from lexigrove.plans.registry import Tables
from lexigrove.sources import source_code as S


def test_one_file_of_parts_is_many_tasks(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.part.rdd.getNumPartitions() == 1
    assert S.extract(code.files(t)).rdd.getNumPartitions() > 1 and S.parsed_edits(code.answers(t)).rdd.getNumPartitions() > 1


def test_diffs_take_all_answers_of_a_file_without_a_group_each(spark):
    files = spark.createDataFrame([("a.py", "x = 1\ny = 2\n"), ("b.py", "z"), ("c.py", "c")], "path string, content string")
    edit = "<<<<<<< SEARCH\n{}\n=======\n{}\n>>>>>>> REPLACE"
    told = spark.createDataFrame([("a.py", edit.format("x = 1", "x = 3")), ("a.py", edit.format("y = 2", "y = 4")), ("b.py", None), ("gone.py", "x")], "path string, answer string")
    out = S.diffs(told, files)
    got = {r["path"]: r for r in out.collect()}
    assert set(got) == {"a.py", "b.py"} and "+x = 3" in got["a.py"]["diff"] and "+y = 4" in got["a.py"]["diff"] and list(got["b.py"]["statuses"]) == []
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
