"""Recurring lines that earlier limits kept: short documents, long lines, few documents."""

import random

from lexigrove.llm import line_templates
from tests.llm.lines_reference import recurring


def dropped(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_templates.drop_recurring(docs).collect()}
    assert got == recurring(rows)
    return got


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_documents_of_recurring_lines(spark):
    """Lines that recur go even where they are most of a document; lines that only copies share stay."""
    draw = random.Random(1)
    shared = [words(draw, 20), words(draw, 20)]
    rows = [(i, "\n".join([*shared, words(draw, 10)])) for i in range(12)]
    copy = "\n".join([*(words(draw, 15) for _ in range(6)), shared[0]])
    rows += [(100 + i, copy) for i in range(12)]
    got = dropped(spark, rows)
    assert all(got[i][1] == 2 for i in range(12))
    assert all(got[100 + i][2] == copy.rsplit("\n", 1)[0] for i in range(12))


def test_long_lines_with_a_changed_word(spark):
    """A passage of 70 words with another name each time is found as one of 60 words is."""
    draw = random.Random(2)
    rows = []
    for n, first in ((60, 0), (70, 100)):
        passage = words(draw, n).split(" ")
        for i in range(12):
            passage[20] = words(draw, 1)
            rows.append((first + i, "\n".join([" ".join(passage), *(words(draw, 15) for _ in range(6))])))
    got = dropped(spark, rows)
    assert all(r[1] == 1 for r in got.values())


def test_passages_in_few_documents(spark):
    """A passage of 55 words in three documents stays in the first alone; of 45 words, or in copies, it stays in all."""
    draw = random.Random(3)
    rows = []
    for n, first in ((55, 0), (45, 100)):
        passage = words(draw, n)
        rows += [(first + i, "\n".join([words(draw, 80), passage])) for i in range(3)]
    rows += [(200 + i, copy) for copy in ["\n".join([words(draw, 60), words(draw, 20)])] for i in range(3)]
    got = dropped(spark, rows)
    assert {i for i, r in got.items() if r[1]} == {1, 2} and got[1][2] == rows[1][1].split("\n")[0]


def test_repeated_rows_and_a_document_of_one_line(spark):
    """Twelve documents with one line in common and a thirteenth that is nothing else; repeated rows change nothing."""
    draw = random.Random(4)
    line = words(draw, 12)
    rows = [(i, "\n".join([words(draw, 15), line, words(draw, 15)])) for i in range(12)] + [(12, line)]
    got = dropped(spark, rows)
    assert all(r[1] == 1 for r in got.values()) and got[12][2] == ""
    again = dropped(spark, rows + rows[:2] + [(50, None), (51, ""), (52, " \n\t\n")])
    assert {i: again[i] for i in got} == got and again[50] == (0, 0, None) and again[52] == (3, 0, " \n\t\n")


def test_edited_copies_count_once(spark):
    """Thirty copies of a document, a word changed in each, keep their lines; what they share with others goes."""
    draw = random.Random(6)
    shared = words(draw, 12)
    base = [words(draw, 14) for _ in range(20)]
    rows = [(0, "\n".join([*base, shared]))]
    for i in range(1, 31):
        edited = list(base)
        edited[i % 20] = edited[i % 20].replace(edited[i % 20].split(" ")[5], words(draw, 1))
        rows.append((i, "\n".join([*edited, shared])))
    rows += [(100 + i, "\n".join([words(draw, 20), shared])) for i in range(10)]
    got = dropped(spark, rows)
    assert all(r[1] == 1 for r in got.values())


def test_slices_of_a_leaf(spark):
    """A leaf that is parsed in slices finds the same recurring template."""
    draw = random.Random(7)
    line = words(draw, 20).split(" ")
    rows = []
    for i in range(40):
        line[10], line[15] = words(draw, 1), words(draw, 1)
        rows.append((i, "\n".join([words(draw, 30), " ".join(line)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_templates.drop_recurring(docs, slice_lines=8)
    assert all(r["n_dropped"] == 1 for r in got.collect())


def test_odd_rows(spark):
    """Null ids stay whole, clashing columns are replaced, a line of a megabyte is a line, an empty table stays empty."""
    draw = random.Random(8)
    line = words(draw, 9)
    rows = [(i if i else None, f"{line}\n{words(draw, 9)}", 7) for i in range(14)] + [(99, f"{line}\n{'x ' * 500_000}", 7), (100, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_dropped long")
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(docs).collect()}
    assert got[None]["n_dropped"] == 0 and got[None]["text"] == rows[0][1] and got[99]["n_dropped"] == 1 and got[5]["n_dropped"] == 1
    assert line_templates.drop_recurring(docs.limit(0)).count() == 0


def test_needed_documents_fall_evenly(spark):
    """Lines of 40 to 54 tokens in 2 to 9 documents: one token more never asks for more documents, nor for two fewer."""
    draw = random.Random(21)
    rows, doc, of = [], 0, {}
    for n in range(40, 55):
        for docs in range(2, 10):
            line = words(draw, n)
            for _ in range(docs):
                rows.append((doc, f"{words(draw, 30)}\n{line}"))
                of.setdefault((n, docs), []).append(doc)
                doc += 1
    got = {i: x[1] for i, x in dropped(spark, rows).items()}
    least = [min((d for d in range(2, 10) if sum(got[i] for i in of[n, d]) == d - 1), default=10) for n in range(40, 55)]
    assert least == [10, 10, 10, 9, 8, 7, 6, 5, 4, 3, 2, 2, 2, 2, 2]
