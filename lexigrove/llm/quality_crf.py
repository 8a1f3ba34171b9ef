"""Quality classifier: a linear-chain conditional random field over lines.

Each line of a document has one of two states, bad (0) or good (1). A line's
state score is linear in its own features and in those of the lines before and
after it; a transition matrix ties neighbouring states. Fitting maximises the
conditional likelihood. Labels are known by document only, so a chain to learn
from is several labelled documents one after the other: states change within
it, and what tells a change is learned from its lines. Scoring runs
forward-backward over all lines of a document and averages the marginals of
state 1, weighted by line length.

Features come from bytes in numpy passes; forward-backward advances all
documents of a chunk by one line at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.common import Text, chunks, lean, read_table, sequences, with_fields

#: Bounds of the fitting sample: labelled documents, and the length of one.
#: Scoring has no bound.
SAMPLE_DOCS = 4_000
SAMPLE_DOC_CHARS = 20_000
#: Documents of a chain to learn from.
CHAIN_DOCS = 4
THRESHOLD = 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "mark": b".,;:'\"()-?",
    "loud": b"!",
    "symbol": b"#*$%&|<>=_{}[]\\/~^+@`",
}
_LOOKUP = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
FEATURES = [*_CLASSES, "letter", "long_words", "short_words", "same_as_before", "seen_in_doc", "seen_windows", "few_words", "many_words", "repeated_line", "empty"]
_OWN = len(FEATURES)
#: Own features, those of both neighbours, two flags for the ends, and a constant.
WIDTH = 3 * _OWN + 3


def _sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return (total[end] - total[start]).astype(np.float64)


def _again(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """1 where the same (row, key) stood earlier."""
    order = np.lexsort((np.arange(len(key)), key, row))
    out = np.zeros(len(key))
    if len(key) > 1:
        a, b = order[1:], order[:-1]
        out[a] = (key[a] == key[b]) & (row[a] == row[b])
    return out


def line_features(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features with neighbours, weight, document) of every line."""
    start, end, row = text.lines()
    n = len(start)
    size = (end - start).astype(np.float64)
    own = np.zeros((n, _OWN))
    at = {k: i for i, k in enumerate(FEATURES)}
    data = text.data
    solid = np.maximum(1.0, size)
    for k, table in _LOOKUP.items():
        own[:, at[k]] = _sums(table[data], start, end) / solid
    own[:, at["letter"]] = _sums(_LETTER[data], start, end) / solid
    ws, we, wrow = text.words()
    line_of = np.searchsorted(start, ws, "right") - 1
    if len(ws):
        # Lines of length 0 share their start with the next line; a word belongs to the last of them.
        words = np.bincount(line_of, minlength=n).astype(np.float64)
        h = text.hashes(ws, we)
        length = we - ws
        per = lambda flags: np.bincount(line_of, weights=flags, minlength=n) / np.maximum(1.0, words)
        own[:, at["long_words"]] = per((length > 16).astype(np.float64))
        own[:, at["short_words"]] = per((length <= 2).astype(np.float64))
        same = np.zeros(len(ws))
        same[1:] = (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])
        own[:, at["same_as_before"]] = per(same)
        own[:, at["seen_in_doc"]] = per(_again(wrow, h))
        first = np.flatnonzero(wrow[:-2] == wrow[2:]) if len(ws) > 2 else np.zeros(0, np.int64)
        seen = np.zeros(len(ws))
        if len(first):
            seen[first] = _again(wrow[first], sequences(h, first, 3))
        own[:, at["seen_windows"]] = per(seen)
    else:
        words = np.zeros(n)
    own[:, at["few_words"]] = (words < 4) / 2.0
    own[:, at["many_words"]] = np.log1p(words) / 6.0
    own[:, at["repeated_line"]] = _again(row, text.hashes(start, end)) * (size > 0)
    own[:, at["empty"]] = size == 0
    return with_neighbours(own, row), size + 1, row


def with_neighbours(own: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Own features of each line, those of the lines before and after it in its chain, and the chain's ends."""
    n = len(own)
    full = np.zeros((n, WIDTH))
    full[:, :_OWN] = own
    has_prev = np.zeros(n, bool)
    has_prev[1:] = row[1:] == row[:-1]
    has_next = np.zeros(n, bool)
    has_next[:-1] = has_prev[1:]
    full[1:, _OWN : 2 * _OWN] = own[:-1]
    full[~has_prev, _OWN : 2 * _OWN] = 0
    full[:-1, 2 * _OWN : 3 * _OWN] = own[1:]
    full[~has_next, 2 * _OWN : 3 * _OWN] = 0
    full[:, -3], full[:, -2], full[:, -1] = ~has_prev, ~has_next, 1
    return full


@dataclass
class Model:
    """Weights of state 1 (state 0 has none) and the log transition scores."""

    weights: np.ndarray
    transition: np.ndarray

    def vector(self) -> np.ndarray:
        return np.concatenate((self.weights, self.transition.ravel()))

    @staticmethod
    def of(v: np.ndarray) -> Model:
        return Model(v[:-4], v[-4:].reshape(2, 2))


class Chains:
    """Lines of several documents, laid out for steps that advance all of them."""

    def __init__(self, row: np.ndarray):
        n = len(row)
        head = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if n else np.zeros(0, np.int64)
        length = np.diff(np.append(head, n))
        order = np.argsort(-length, kind="stable")
        self.head, self.length, self.n = head[order], length[order], n

    def steps(self) -> Iterator[np.ndarray]:
        """Indices of the t-th lines, of the longest documents first."""
        for t in range(int(self.length[0]) if len(self.length) else 0):
            active = int(np.searchsorted(-self.length, -t, "left"))
            yield self.head[:active] + t


def forward_backward(chains: Chains, score: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """Marginals of state 1, log partition (summed), and expected transitions."""
    n = chains.n
    emit = np.stack((np.zeros(n), score), axis=1)
    steps = list(chains.steps())
    alpha = np.zeros((n, 2))
    for t, at in enumerate(steps):
        if t == 0:
            alpha[at] = emit[at]
        else:
            a = alpha[at - 1]
            alpha[at] = emit[at] + np.stack([np.logaddexp(a[:, 0] + transition[0, y], a[:, 1] + transition[1, y]) for y in (0, 1)], axis=1)
    beta = np.zeros((n, 2))
    expected = np.zeros((2, 2))
    z = np.zeros(n)
    last = chains.head + chains.length - 1
    logz = np.logaddexp(alpha[last, 0], alpha[last, 1])
    for t in range(len(steps) - 1, -1, -1):
        at = steps[t]
        z[at] = logz[: len(at)]
        if t + 1 < len(steps):
            nxt = steps[t + 1]
            here = nxt - 1
            f = emit[nxt] + beta[nxt]
            beta[here] = np.stack([np.logaddexp(transition[y, 0] + f[:, 0], transition[y, 1] + f[:, 1]) for y in (0, 1)], axis=1)
            if pairs:
                for i in (0, 1):
                    for j in (0, 1):
                        expected[i, j] += np.exp(alpha[here, i] + transition[i, j] + f[:, j] - z[here]).sum()
    return np.exp(np.minimum(0.0, alpha[:, 1] + beta[:, 1] - z)), float(logz.sum()), expected


def fit(x: np.ndarray, row: np.ndarray, label: np.ndarray, rounds: int = 80, penalty: float = 0.0001) -> Model:
    """Maximum conditional likelihood by L-BFGS; ``label`` is one per line."""
    start = Model(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if len(row) == 0 or label.min() == label.max():
        return start
    chains = Chains(row)
    inner = row[1:] == row[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][inner], label[1:][inner]), 1)
    target = x.T @ label
    n = len(np.unique(row))

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        m = Model.of(v)
        score = x @ m.weights
        p, logz, expected = forward_backward(chains, score, m.transition, True)
        value = logz - score @ label - (m.transition * seen).sum() + penalty * n * (v @ v) / 2
        return value / n, (np.concatenate((x.T @ p - target, (expected - seen).ravel())) + penalty * n * v) / n

    v = start.vector()
    value, g = loss(v)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, stack = g.copy(), []
        for s, y in reversed(memory):
            a = (s @ q) / (s @ y)
            q -= a * y
            stack.append(a)
        if memory:
            s, y = memory[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(memory, reversed(stack), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step = 1.0 if memory else 1.0 / max(1.0, float(np.abs(g).sum()))
        while step > 1e-6:
            new, new_g = loss(v - step * q)
            if new <= value - 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            break
        s, y = -step * q, new_g - g
        if s @ y > 1e-10:
            memory = [*memory, (s, y)][-8:]
        done = value - new < 1e-6
        v, value, g = v + s, new, new_g
        if done:
            break
    return Model.of(v)


def score_texts(model: Model, text: Text) -> tuple[np.ndarray, np.ndarray]:
    """(score, lines) of each document of a chunk."""
    x, weight, row = line_features(text)
    p, _, _ = forward_backward(Chains(row), x @ model.weights, model.transition)
    total = np.bincount(row, weights=weight, minlength=text.n)
    return np.bincount(row, weights=weight * p, minlength=text.n) / total, np.bincount(row, minlength=text.n)


def held_out(doc_id: str = "doc_id"):
    """Column: the row is kept out of fitting."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, doc_chars: int = SAMPLE_DOC_CHARS) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out.

    ``sample_docs`` documents of at most ``doc_chars`` characters, in the order
    of a hash of their id. Without labels, or with one class only, the model
    has no weights and scores 0.5.
    """
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_docs)
    )
    # The sample has at most 2 * sample_docs ids, so its broadcast is bounded.
    sample = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= doc_chars)
        .join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality = batch.column(1).to_numpy(zero_copy_only=False)
            x, _, row = line_features(Text(batch.column(0)))
            for k in range(batch.num_rows):
                mine = x[row == k, :_OWN].astype(np.float32)
                yield pa.RecordBatch.from_pydict({"quality": pa.array([quality[k]], pa.int32()), "lines": pa.array([mine.tobytes()], pa.binary())})

    found = sample.select("text", "quality").mapInArrow(lean(run), "quality int, lines binary").collect()
    # In the order of a hash of what is learned from: the same for any order of the rows.
    found.sort(key=lambda r: (xxhash.xxh3_64_intdigest(r["lines"]), r["quality"], r["lines"]))
    parts = [np.frombuffer(r["lines"], np.float32).reshape(-1, _OWN) for r in found]
    if not parts:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)))
    count = [len(p) for p in parts]
    chain = np.repeat(np.arange(len(parts)) // CHAIN_DOCS, count)
    label = np.repeat([int(r["quality"] > 0) for r in found], count)
    return fit(with_neighbours(np.concatenate(parts).astype(np.float64), chain), chain, label)


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1) and ``quality_lines``.

    Whole texts are scored; null and empty ones are one empty line. All other
    columns pass through; columns with the two names are replaced. An empty
    table stays empty.
    """
    kept = docs.drop("quality_score", "quality_lines")
    schema = with_fields(kept, "quality_score double, quality_lines long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                score, lines = score_texts(model, Text(part.column(part.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(lines.astype(np.int64))], names=[*part.schema.names, "quality_score", "quality_lines"])

    return kept.mapInArrow(lean(run), schema)


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model fitted on the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"), "quality_lines",
    )


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: keep the documents that score at least the threshold.

    Null and empty texts have the score of no evidence, the same for both;
    each row is scored on its own, repeated ones alike; null ids and other
    columns pass through; an empty table stays empty.
    """
    model = train(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).filter(F.col("quality_score") >= THRESHOLD).select(*docs.columns)
