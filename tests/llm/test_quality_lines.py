"""Lines carry their own evidence: held-out accuracy, and documents that are half good and half bad."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lexigrove.llm import quality_crf
from lexigrove.llm.common import Text

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    model = quality_crf.train(docs.select("doc_id", "text"), labels, sample_docs=1_500)
    held = docs.select("doc_id", "text").join(labels.filter("quality is not null"), "doc_id").filter(quality_crf.held_out())
    rows = quality_crf.score_documents(held, model).toPandas()
    return model, rows


def test_held_out(fitted):
    _, rows = fitted
    y, rank = rows["quality"].to_numpy(), rows["quality_score"].rank().to_numpy()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    assert (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.99
    assert ((rows["quality_score"] >= quality_crf.THRESHOLD) == y).mean() > 0.97


def test_half_good_half_bad(fitted):
    model, rows = fitted
    parts = {q: [t.split("\n")[:8] for t in rows[rows["quality"] == q]["text"] if t.count("\n") > 1] for q in (0, 1)}
    apart = []
    for good, bad in zip(parts[1], parts[0], strict=False):
        x, _, row = quality_crf.line_features(Text(pa.array(["\n".join(good + bad)])))
        p, _, _ = quality_crf.forward_backward(quality_crf.Chains(row), x @ model.weights, model.transition)
        apart.append(p[: len(good)].mean() > 0.7 and p[len(good) :].mean() < 0.3)
    assert len(apart) > 20 and np.mean(apart) > 0.8


def test_marginals_vary_within_documents(fitted):
    model, rows = fitted
    x, _, row = quality_crf.line_features(Text(pa.array(rows["text"])))
    p, _, _ = quality_crf.forward_backward(quality_crf.Chains(row), x @ model.weights, model.transition)
    spread = pd.Series(p).groupby(row).agg(lambda v: v.max() - v.min())[np.bincount(row) > 1]
    assert (spread > 0.01).mean() > 0.1


def test_odd_rows(spark, fitted):
    """Null and empty texts, null ids, repeated rows, clashing columns, a long text, empty tables, no labels."""
    model, _ = fitted
    rows = [(1, None, 0.5), (2, "", None), (None, "a line", 1.0), (3, "word " * 400_000, 1.0), (4, "same", 1.0), (4, "same", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score double")
    got = quality_crf.score_documents(docs, model).collect()
    assert len(got) == 6 and all(0 <= r["quality_score"] <= 1 for r in got) and len({r["quality_score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert quality_crf.score_documents(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    blank = quality_crf.train(docs, labels)
    assert not blank.weights.any() and all(r["quality_score"] == 0.5 for r in quality_crf.score_documents(docs, blank).collect())
