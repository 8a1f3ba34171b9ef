"""Null ids, repeated rows, clashing columns, long texts and empty tables, operator by operator; digests by the plain definition."""

import hashlib
import math
import random

from lexigrove.llm import fingerprint, mixing, prefix_free, rules
from lexigrove.llm.bpe import decode_column, encode_column, round_trips, tokenizer_path

draw = random.Random(12)


def words(n):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(n))


def plain_digest(data):
    """The quartile digest, triplet by triplet."""
    counts = [0] * 256
    for k, (p, q) in enumerate(((1, 2), (1, 3), (2, 3))):
        for i in range(len(data) - q):
            h = (data[i] * 0x9E3779B1 + data[i + p] * 0x85EBCA6B + data[i + q] * 0xC2B2AE35 + 0x27D4EB2F * k) * 0x2C1B3C6D
            counts[h % 2**32 >> 24] += 1
    first, second, third = (sorted(counts)[n - 1] for n in (64, 128, 192))
    code = [(c > first) + (c > second) + (c > third) for c in counts]
    body = [sum(code[i + j] << 2 * j for j in range(4)) for i in range(0, 256, 4)]
    return bytes([min(255, round(8 * math.log2(len(data) + 1))), *body])


def plain_likeness(a, b):
    gap = {0: 0, 1: 1, 2: 2, 3: 6}
    two = lambda d: [x >> 2 * j & 3 for x in d[1:] for j in range(4)]
    return 1 - (sum(gap[abs(x - y)] for x, y in zip(two(a), two(b), strict=True)) + min(64, abs(a[0] - b[0]))) / (6 * 256 + 64)


def test_digests():
    texts = [b"", b"a", b"ab", b"abc", "é".encode() * 40, words(3).encode(), words(300).encode(), bytes(range(256)) * 3]
    for a in texts:
        assert fingerprint.digest(a) == plain_digest(a)
        for b in texts:
            assert fingerprint.likeness(plain_digest(a), plain_digest(b)) == plain_likeness(plain_digest(a), plain_digest(b))
    base = words(400).split(" ")
    edited = [*base[:200], "changed", *base[201:]]
    same = fingerprint.likeness(*(fingerprint.digest(" ".join(x).encode()) for x in (base, edited)))
    other = fingerprint.likeness(*(fingerprint.digest(x.encode()) for x in (" ".join(base), "QRSTUVWXYZ 0123456789 " * 90)))
    assert same > 0.95 > 0.7 > other


def test_fingerprints_of_odd_rows(spark):
    """A null id comes first, rows of one id go by text, a single row is its own next, a long text is read whole."""
    long = words(200_000)
    rows = [(None, "null id"), (1, "b"), (1, "a"), (1, "a"), (2, None), (3, long)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    got = {}
    for r in fingerprint.compare_with_next(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert {i: len(x) for i, x in got.items()} == {None: 1, 1: 3, 2: 1, 3: 1}
    changed = long[: len(long) - len(long) // 2] + "null id"
    assert got[3][0]["n_chars"] == len(long) and got[3][0]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    ends = {hashlib.sha256(x.encode()).hexdigest() for x in ("null" + "a", "a", "b")}
    assert {r["edited_sha256"] for x in (None, 1) for r in got[x]} == ends
    alone = fingerprint.compare_with_next(docs.filter("doc_id = 2")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == alone[0]["near_edited"] == 1


def test_tokens_of_odd_rows(spark):
    rows = [(None, "x y", "old"), (1, "x y", "old"), (1, "x y", None), (2, None, None), (3, "", None), (4, words(60_000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    path = tokenizer_path()
    got = [tuple(r) for r in round_trips(docs, path).collect()]
    assert len(got) == 6 and len({r[1:] for r in got if r[0] in (None, 1)}) == 1 and {r[1] for r in got if r[0] in (2, 3)} == {0}
    assert next(r[3] for r in got if r[0] == 4) == hashlib.sha256(rows[5][1].encode()).hexdigest()
    both = decode_column(encode_column(docs, path), path)
    assert [r["decoded"] for r in both.collect()] == [t or "" for _, t, _ in rows]
    assert round_trips(docs.limit(0), path).count() == 0 and encode_column(docs.limit(0), path).count() == 0


def test_repeats_of_odd_rows(spark):
    """A null id is earlier than all; rows of one id are not earlier than each other; a clashing column does not matter."""
    text, once, long = words(40), words(40), words(100_000)
    rows = [(None, text), (1, text), (2, once), (2, once), (3, None), (4, long), (5, long)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_bytes int")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], len(r["kept"])) for r in prefix_free.remove_repeats(docs).collect())
    n, m, k = len(text), len(once), len(long)
    assert got == [(0, n, n), (1, n, 0), (2, m, m), (2, m, m), (3, 0, 0), (4, k, k), (5, k, 0)]


def test_mix_of_odd_rows(spark):
    """A table of one null source without words takes nothing; a long text counts whole."""
    blank = spark.createDataFrame([(1, None, None), (None, " \n", None)], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.take_counts(blank).collect()} == {(0, 0.0, 0)}
    long = spark.createDataFrame([(1, words(100_000), "s", "x")], "doc_id long, text string, source string, level string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.take_counts(long).collect()] == [(100_000, 100_000.0, 100_000)]


def test_rules_of_odd_rows(spark):
    text = words(100_000)
    rows = [(None, "a b", 9), (1, "a b", 9), (1, "a b", 9), (2, None, None), (3, text, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], bool(r["fail_bits"] & rules.BIT["few_words"])) for r in rules.ledger(docs).collect())
    assert got == [(0, 2, 2, True), (1, 2, 2, True), (1, 2, 2, True), (2, 0, 0, True), (3, 100_000, len(text) - 99_999, False)]
    assert {r["n_failed"] for r in rules.ablations(rules.ledger(docs.limit(0))).collect()} == {0}
