"""Queries against the SQL of their definition, on texts of many kinds."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lexigrove.llm import registry

HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<<SYS>>\\<</SYS>>", "<|end|", "[INST", "<s", "é<|text|>ß", ""]


def conversations():
    draw = random.Random(5)
    rows = []
    for conv in range(40):
        for turn in range(draw.randrange(1, 6)):
            role = draw.choice(["user", "assistant", "system", "tool", "<|end|>", None])
            text = draw.choice([None, "plain words", "".join(draw.choices(HOSTILE, k=4))])
            rows.append((conv, turn, role, text))
    draw.shuffle(rows)
    return pa.table([list(c) for c in zip(*rows)], schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))


def documents():
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdeéß漢", k=draw.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    texts = [None, "", " \n\t", "a", "A b", "a B", "a b c", "ä", "\n", passage, passage.upper(), f"{text(20)}\n{passage} {text(7)}", f"{passage}{passage}"]
    base = [text(90) for _ in range(3)]
    for b in base:
        texts += [b, b, b.replace(" ", " ", 1), b + " end", "start " + b, b + " " + text(6), b + " " + text(30)]
    for p in range(1, 12):
        period = [word() for _ in range(p)]
        texts += [" ".join(period * 9), f"{text(11)} {' '.join(period * 3)} {' '.join(period[:1])} {text(9)}", " ".join((period * 30)[: 3 * p + 20])]
    texts += [text(draw.randrange(1, 200)) for _ in range(60)]
    texts += ["x " * 3000, "0123456789" * 200]
    ids = draw.sample(range(1000), len(texts))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    pq.write_table(conversations(), out / "conversations.parquet")
    pq.write_table(documents(), out / "documents.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_fingerprint", "op6_prefix_free_dedup", "op9_ngram_join", "op13_periodic_runs"])
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: r[0]
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_cases_are_met(spark, folder):
    """The texts above do hold links, removed bytes and runs."""
    q = registry.queries()
    assert q["op9_ngram_join"](spark, folder).filter("component_id <> doc_id").count() > 8
    assert q["op6_prefix_free_dedup"](spark, folder).filter("n_removed > 0").count() > 8
    assert q["op13_periodic_runs"](spark, folder).filter("n_runs > 0").count() > 20
