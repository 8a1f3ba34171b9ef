"""Files are fetched for edits that no retrieved node holds, and nodes are searched once."""

from lexigrove.sources import source_code as S


def test_only_files_of_edits_left_are_searched(spark, monkeypatch):
    edits = spark.createDataFrame([(1, 10, "x = 1"), (2, 20, "y = 2"), (3, 30, "z = 3")], "query_id long, edit_id long, before string")
    ranked = spark.createDataFrame([(1, 1, "a.py", 4, "x = 1"), (2, 1, "b.py", 1, "q = 0"), (3, 1, "c.py", 1, None)], "query_id long, rank long, file string, start_line long, source string")
    files = spark.createDataFrame([("a.py", "\n\n\nx = 1"), ("b.py", "p = 1\ny = 2"), ("c.py", "k")], "file string, content string")
    searched, plain = [], S.find_edits

    def find(edits, texts, key):
        searched.append(sorted(r["file"] for r in texts.collect()))
        return plain(edits, texts, key)

    monkeypatch.setattr(S, "find_edits", find)
    found = S.locate(edits, ranked, files).collect()
    assert sorted((r["edit_id"], r["file"], r["line"], r["status"]) for r in found if r["file"]) == [(10, "a.py", 4, "exact"), (20, "b.py", 2, "exact")]
    assert [r["status"] for r in found if r["edit_id"] == 30] == ["not_found"]
    assert searched == [["a.py", "b.py"], ["b.py", "c.py"]]
