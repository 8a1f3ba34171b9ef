"""The pipeline against a plain reading of its five stages, and its stages on odd rows."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from lexigrove.llm import line_templates, quality_crf
from lexigrove.llm.bpe import tokenizer_path
from lexigrove.llm.common import Text, materialize
from tests.llm.lines_reference import pairs_of_copies, recurring

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def quality(model, text):
    """Length-weighted marginal of state 1, summed over the states line by line; the features are the operator's."""
    x, weight, _ = quality_crf.line_features(Text(pa.array([text or ""])))
    emit = np.exp(np.stack([np.zeros(len(x)), x @ model.weights], axis=1))
    step = np.exp(model.transition)
    ahead, back = [emit[0] / emit[0].sum()], [np.ones(2)]
    for e in emit[1:]:
        a = (ahead[-1] @ step) * e
        ahead.append(a / a.sum())
    for e in emit[:0:-1]:
        b = step @ (e * back[-1])
        back.append(b / b.sum())
    both = np.array(ahead) * np.array(back[::-1])
    return float((both[:, 1] / both.sum(axis=1) * weight).sum() / weight.sum())


def first_of_each_group(rows):
    """Rows but those that links of 0.8 on five words tie to a smaller id."""
    sets = {}
    for i, text, _ in rows:
        w = WORD.findall((text or "").translate(ASCII_LOWER))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and group[a] != group[b] and (common := len(sets[a] & sets[b])) and 5 * common >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return [r for r in rows if group[r[0]] == r[0]]


def mixed(rows):
    """Each row as often as the mix takes it."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, goal, todo = float(sum(size.values())), {}, list(names)
    while over := [s for s in todo if left * weight[s] / sum(weight[x] for x in todo) > 3 * size[s]]:
        for s in over:
            goal[s] = 3.0 * size[s]
        left = sum(size.values()) - sum(goal.values())
        todo = [s for s in todo if s not in over]
    goal |= {s: left * weight[s] / sum(weight[x] for x in todo) for s in todo}
    rate = {s: goal[s] / size[s] if size[s] else 0.0 for s in names}

    def again(doc, source):
        return int(hashlib.md5(f"mix-0:{doc}".encode()).hexdigest()[:13], 16) / 16.0**13 < rate[source] - int(rate[source])

    return [r for r in rows for _ in range(int(rate[r[2]]) + again(r[0], r[2]))]


def test_against_a_plain_reading(spark):
    """Every stage once more, row by row, on the stage's own input.

    Which documents are copies is an estimate of line dedup's, held against all pairs here; its lines are read by the groups that it made.
    """
    docs, labels = (spark.read.parquet(f"{DATA}/{x}.parquet") for x in ("documents", "labels"))
    model = quality_crf.train(docs.select("doc_id", "text"), labels)
    listed = lambda df: sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)
    made, out = [listed(docs)], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, out, DATA))
        made.append(listed(out))
    raw, good, lines, firsts, mix = made
    assert good == [r for r in raw if quality(model, r[1]) >= 0.3] and len(good) < len(raw)
    known = spark.createDataFrame([r[:2] for r in good], "doc_id long, text string")
    found = line_templates.recurring_lines(known).select("doc_id").distinct()
    groups = {r["id"]: r["root"] for r in line_templates.copies_of(known, found).collect()}
    asked = {r["doc_id"] for r in found.collect()}
    same = lambda pairs: [groups.get(a, a) == groups.get(b, b) for a, b in pairs if a in asked and b in asked]
    sure, likely = (same(pairs_of_copies([r[:2] for r in good], s)) for s in (0.8, 0.7))
    assert all(sure) and sum(likely) >= 0.9 * len(likely) and len(sure) > 5
    unlike = same(set(itertools.combinations(sorted(asked), 2)) - {tuple(sorted(p)) for p in pairs_of_copies([r[:2] for r in good], 0.5)})
    assert sum(unlike) <= 0.01 * len(unlike)
    kept = recurring([r[:2] for r in good], told=groups)
    assert lines == sorted(((i, kept[i][2], s) for i, _, s in good), key=str) and sum(k[1] for k in kept.values()) > 0
    assert firsts == first_of_each_group(lines) and len(firsts) < len(lines)
    assert mix == sorted(mixed(firsts), key=str)
    library, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for i, text, _ in mix:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digests = (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        want[i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in digests)] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == want


def test_stages_on_odd_rows(spark):
    """Null ids, texts and sources, repeated rows, a long text and empty tables pass all stages; columns stay as they were."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    some = docs.limit(20)
    odd = [(None, "a plain line of words that reads well enough", None, None, None), (900_001, None, "en", "s", 0), (900_002, "", None, "s", 0), (900_003, "word " * 200_000, "en", None, 1)]
    frame = materialize(some.unionByName(some).unionByName(spark.createDataFrame(odd, docs.schema)))
    for rows in (frame, frame.limit(0)):
        seen = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = materialize(stage(spark, seen, DATA))
            assert seen.columns == docs.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, seen, DATA)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == seen.count()
