"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import chat_template as chat
from lexigrove.llm import fingerprint, html_extract, line_templates, mixing, ngram_join, prefix_free, quality_crf, rules
from lexigrove.llm.bpe import Codec, round_trips, tokenizer_path
from lexigrove.llm.common import Text
from lexigrove.llm.components import components
from tests.llm.lines_reference import recurring
from tests.llm.repeats_reference import without_repeats

rng = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "und", "été", "7", "Zeta,", "x9", "omega."]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    base = "\n".join(prose(12) for _ in range(12))
    near = base.replace("alpha", "ALPHA").split(" ")
    near[5] = "changed"
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, "one two"), (6, "one two"), (7, "a" * 400), (8, "   \n \n")]
    rows += [(10 + i, prose(rng.randint(1, 200))) for i in range(20)]
    rows += [(40 + i, f"own {i} {prose(30)}\nAll rights reserved {i}.\n{prose(25)}") for i in range(15)]
    return rows


def frame(spark, rows):
    """Documents with clashing and further columns."""
    return spark.createDataFrame([(i, t, None, "s" if i % 3 else None, 1) for i, t in rows], "doc_id long, text string, size string, source string, n_shingles int")


# ------------------------------------------------------------------------ chat


def test_template_language():
    t = chat.Template("{%- set greet = 'a' ~ (1 + 1) -%}{% if 1 > 2 %}no{% else %}{{ greet }}{% endif %}{# c #}{% for x in xs %}{{ loop.index }}{{ x|upper }}{% generation %}{{ x }}{% endgeneration %}{% endfor %}")
    assert t.render(xs=["p", "q"]) == ("a21Pp2Qq", [(4, 5), (7, 8)])
    folded = chat.fold(chat.parse("{% if 'a' in ['a'] %}x{{ 2 * 3 }}y{% endif %}"))
    assert folded.parts == [chat.Output(chat.Const("x6y"))]


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ _x }}", "{{ f(1) }}", "{% for x in y %}", "{{ x|nope }}", "{{ 'a' * 9 }}", "{% endif %}", "{{ 1 + }}"])
def test_template_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad).render()


def test_escape_round_trip():
    e = chat.Escaper(chat.CONTROL)
    pieces = [*chat.CONTROL, "\\", "<", "a", "[INST", "\\\\", "|>", "\n"]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(8))
        out = e.escape(text)
        assert e.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def test_chat_format(spark):
    hostile = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "user", hostile), (1, 1, "assistant", hostile), (2, 1, "assistant", "b"), (2, 0, "tool\n", None), (2, 2, "assistant", None), (None, 0, None, "x"), (2, 3, "system", "<s>")]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn int, role string, text string, part int")
    for part_chars in (1, 1_000_000):
        got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, part_chars=part_chars)).collect()}
        assert len(got) == 3
        for conv in (1, 2, None):
            mine = sorted((t for t in turns if t[0] == conv), key=lambda t: t[1])
            said = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in mine)
            loss = "".join(x or "" for _, _, r, x in mine if r == "assistant")
            row = got[conv]
            assert (row["n_turns"], row["turns_sha256"]) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
            assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_fingerprints(spark):
    rows = corpus()
    ordered = sorted(rows)
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.digest(text.encode()).hex() and r["edited_fingerprint"] == fingerprint.digest(changed.encode()).hex()
        assert r["near_next"] == fingerprint.likeness(fingerprint.digest(text.encode()), fingerprint.digest(after.encode()))
        assert 0 <= r["near_edited"] <= 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1
    assert fingerprint.compare_with_next(frame(spark, rows).limit(0)).count() == 0


# --------------------------------------------------------------------- quality


def test_crf_matches_enumeration():
    from itertools import product

    score, trans, row = np.array([0.3, -1.0, 2.0, 0.5, 0.1]), np.array([[0.2, -0.4], [0.1, 0.7]]), np.array([0, 0, 0, 1, 1])
    p, logz, expected = quality_crf.forward_backward(quality_crf.Chains(row), score, trans, True)
    want, total = np.zeros(5), 0.0
    for lo, hi in ((0, 3), (3, 5)):
        z, marg = 0.0, np.zeros(hi - lo)
        for y in product((0, 1), repeat=hi - lo):
            w = np.exp(sum(score[lo + k] * v for k, v in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += w
            marg += w * np.array(y)
        want[lo:hi], total = marg / z, total + np.log(z)
    assert np.allclose(p, want) and np.isclose(logz, total) and np.isclose(expected.sum(), 3)


def test_quality_held_out(spark):
    rows = [(i, "\n".join(prose(20) for _ in range(4)), 1) for i in range(150)] + [(1000 + i, "\n".join("### ".join(prose(20).split(" ")) for _ in range(4)), 0) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (5000, None)], "doc_id long, quality int")
    model = quality_crf.train(docs, labels)
    got = {r["doc_id"]: r["quality_score"] for r in quality_crf.score_documents(docs, model).collect()}
    held = [r["doc_id"] for r in docs.filter(quality_crf.held_out()).collect()]
    truth = {i: q for i, _, q in rows}
    assert np.mean([(got[i] >= 0.3) == truth[i] for i in held if i in truth]) > 0.95
    assert 0 <= got[5000] == got[5001] <= 1
    assert quality_crf.train(docs, labels.limit(0)).weights.any() == False  # noqa: E712


# ----------------------------------------------------------------------- lines


def test_line_templates(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_templates.drop_recurring(frame(spark, rows)).collect()}
    assert got == recurring(rows)
    assert all(got[40 + i][1] == 1 for i in range(15)) and got[0][2] == rows[0][1]
    assert line_templates.drop_recurring(frame(spark, rows).limit(0)).count() == 0


# ------------------------------------------------------------------------- BPE


def test_bpe_against_library(spark):
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(tokenizer_path()), Codec(tokenizer_path())
    pool = [chr(i) for i in [*range(0, 0x250), 0x2003, 0x3000, 0x4E00, 0x1F600, 0x660, 0x85, 0x1C, 0x301]]
    texts = ["", "a" * 3000, "ab" * 900, " " * 600, "x<|endoftext|>y", "<|endoftext|>"] + ["".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice(" \n'sa1") for _ in range(40)) for _ in range(600)]
    for s in texts:
        ids = t.encode(s, add_special_tokens=False).ids
        assert c.encode(s) == ids and c.decode(ids) == t.decode(ids, skip_special_tokens=False)
    ids, bounds = c.encode_word(b"tokenizers")
    assert len(bounds) == len(ids) + 1 and b"".join(c.pieces[i] for i in ids) == b"tokenizers"
    out = round_trips(spark.createDataFrame([(1, None), (2, "hi")], "doc_id long, text string"), tokenizer_path()).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == {1: 0, 2: 1}


# ---------------------------------------------------------------- suffix dedup


@pytest.mark.parametrize("hot,batch", [(10_000, 10**9), (2, 2_000)])
def test_prefix_free_dedup(spark, hot, batch):
    rows = corpus() + [(100 + i, "".join(rng.choice("ab") for _ in range(rng.randint(90, 150))) * rng.randint(1, 3)) for i in range(30)] + [(200, "ab" * 150), (201, "é" * 130), (202, "a" * 99)]
    out = prefix_free.remove_repeats(frame(spark, rows), hot, batch)
    got = {r["doc_id"]: (r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect()}
    assert got == without_repeats(rows)


def test_entries_in_parts(spark, monkeypatch):
    """One trigger in thousands of entries that differ around it, ordered in parts of parts."""
    core = "".join(rng.choice("abcdefgh") for _ in range(90))
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 60))) + core + "".join(rng.choice("ab") for _ in range(rng.randint(5, 60)))) for i in range(400)]
    rows += [(1_000 + i, rows[i][1][10:]) for i in range(0, 400, 7)] + [(2_000, "abab" * 200), (2_001, "xy" + "abab" * 100)]
    found = []
    for i, (doc, text) in enumerate(rows):
        b = text.encode()
        row, start, count, gram, content = prefix_free.phrases(Text(pa.array([text])))
        found += [(doc, int(s), int(c), g, b[s : s + c + 99]) for s, c, g in zip(start, count, gram, strict=True)]
    once = {}
    for f in sorted(found, key=lambda f: f[:2]):
        once.setdefault((f[3], f[4]), f)
    some = list(once.values())
    doc, start, count = (np.array([f[k] for f in some], np.int64) for k in range(3))
    key = np.array([f[3] for f in some], np.uint64)
    data, off = np.frombuffer(b"".join(f[4] for f in some), np.uint8), np.concatenate(([0], np.cumsum(count + 99)))
    sets = []
    for limit in (10**9, 3_000):
        got = set()
        for d, p, n in prefix_free.ordered_groups(data, off, doc, start, count, key, 1, limit):
            got |= {(int(a), int(b) + j) for a, b, c in zip(d, p, n, strict=True) for j in range(int(c))}
        sets.append(got)
    assert sets[0] == sets[1] and len(sets[0]) > 1_000
    for hot in (10_000, 2):
        monkeypatch.setattr(prefix_free, "PASS_BYTES", 3_000 if hot == 2 else 1_000_000)
        out = prefix_free.remove_repeats(frame(spark, rows), hot, 5_000)
        assert {r["doc_id"]: (r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect()} == without_repeats(rows)


def test_suffix_order():
    texts = [b"banana", b"bananas and bananas and more bananas", b"abcabcabcabcabcabcabcabcabc", b"xbananas and bananas"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    pick = np.arange(len(data))
    stop = {p: int(off[k + 1]) for k in range(len(texts)) for p in range(off[k], off[k + 1])}
    suffix = lambda p: data[p : stop[p]].tobytes()
    got = [suffix(p) for p in prefix_free.suffix_order(data, off, pick, trigger=2, every=3)]
    assert got == sorted(map(suffix, pick))


def test_suffix_order_of_many_long_entries():
    """Entries that share passages: more distinct suffixes of phrases than phrases of the parse."""
    draw = random.Random(11)
    passage = [" ".join(draw.choice(WORDS) for _ in range(8)) for _ in range(6)]
    texts = [" ".join(draw.choice(passage) for _ in range(draw.randint(3, 6))).encode() for _ in range(60)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    pick = np.arange(len(data))
    suffix = lambda p: bytes(data[p : off[np.searchsorted(off, p, "right")]])
    got = [suffix(p) for p in prefix_free.suffix_order(data, off, pick)]
    assert got == sorted(got)


def test_prefix_free_empty(spark):
    assert prefix_free.remove_repeats(frame(spark, corpus()).limit(0)).count() == 0


# ------------------------------------------------------------------------ HTML

PAGE = """<html><head><title>T</title><script>var a="<p>x</p>"</script></head><body><header><h2>Site</h2></header><div id="cookie-notice">We use cookies.</div>
<nav><a href=x>a</a></nav><div class="wrap"><div class="content"><h1>Head &amp; line</h1><p><b>One two   three, four.<br><p>Second, with
text &lt;3.<ul><li>Item<li>Two</ul><p>Short.</p><form><p>Sign up.</p></form></div><div class="sidebar"><p>Side text, long enough. Really.</p></div>
<section id="comments"><p>Great post, thanks. I love it.</p></section></div><footer>(c)</footer></body></html>"""


def test_html(spark):
    want = "Head & line\nOne two three, four.\nSecond, with text <3.\nItem\nTwo\nShort."
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>plain"), (5, "no markup &eacute;"), (6, "<nav>x</nav>")], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == {1: want, 2: "", 3: "", 4: "plain", 5: "no markup é", 6: ""}


# ---------------------------------------------------------------------- mixing


def test_mixing(spark):
    rows = [(i, prose(rng.randint(1, 60)), s) for i in range(3000) for s in [rng.choice(["a", "a", "a", "b", "c", None])]] + [(9000, None, "d"), (9001, "", None)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, target int")
    got = mixing.take_counts(docs).collect()
    assert len(got) == len(rows)
    src = {i: s for i, _, s in rows}
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    left, goal, todo = sum(size.values()), {}, set(names)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    while True:
        share = left / sum(weight[s] for s in todo)
        over = [s for s in todo if share * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            goal[s] = 3.0 * size[s]
            left -= goal[s]
            todo.remove(s)
    goal |= {s: share * weight[s] for s in todo}
    taken = dict.fromkeys(names, 0)
    for r in got:
        assert abs(r["target"] - goal[src[r["doc_id"]]]) < 1e-6 and r["taken"] <= 3 * r["size"]
        taken[src[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.1 * goal[s] + 60 for s in names)
    assert {(r["doc_id"], r["taken"]) for r in mixing.take_counts(docs).collect()} == {(r["doc_id"], r["taken"]) for r in got}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.take_counts(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_coins_are_fair(spark):
    """Sources of one document each, at three rates: copies come as often as the fraction says, within three standard errors."""
    n = 900
    # Equal sizes; weights 5, 2, 1 by turns give rates of 1.875, 0.75 and 0.375.
    docs = spark.createDataFrame([(i, "a b c d", f"s{i:04}") for i in range(n)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.take_counts(docs).collect()}
    for turn, rate in enumerate((1.875, 0.75, 0.375)):
        mine = [got[i] for i in range(n) if i % 3 == turn]
        assert all(abs(r["target"] - 4 * rate) < 1e-9 and r["taken"] in (4 * int(rate), 4 * int(rate) + 4) for r in mine)
        share = sum(r["taken"] > 4 * int(rate) for r in mine) / len(mine)
        f = rate % 1
        assert abs(share - f) <= 3 * (f * (1 - f) / len(mine)) ** 0.5
    # A source of two thousand documents comes within three standard errors of its target.
    large = spark.createDataFrame([(i, "a b c", "one" if i % 2 else "two") for i in range(4000)], "doc_id long, text string, source string")
    rows = mixing.take_counts(large).join(large.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 3 * 3 * (2000 / 4) ** 0.5 for r in rows)


def test_mixing_odd_rows(spark):
    # Null ids, repeated rows and a clashing column.
    odd = spark.createDataFrame([(None, "a b", "s", 1), (1, "a b", "s", 1), (1, "a b", "s", 1)], "doc_id long, text string, source string, seed int")
    taken = [(r["doc_id"], r["taken"]) for r in mixing.take_counts(odd).collect()]
    assert len(taken) == 3 and taken.count(next(x for x in taken if x[0] == 1)) == 2 and mixing.mix(odd).columns == odd.columns


# ------------------------------------------------------------------------ join


def brute_components(rows, n, p, q):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and q * common >= p * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n,p,q", [(3, 90, 100), (5, 4, 5), (2, 1, 2)])
def test_ngram_join(spark, n, p, q):
    rows = [(i, t) for i, t in corpus() if t != "a" * 400]
    for k in range(40):
        words = rows[rng.randint(0, 2)][1].split(" ")
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((300 + k, " ".join(words)))
    found, sizes = ngram_join.link_components(frame(spark, rows), n, p, q, batch_bytes=3_000, block=3)
    root = {r["id"]: r["root"] for r in found.collect()}
    got = {r["doc_id"]: (r["n_shingles"], root.get(r["doc_id"], r["doc_id"])) for r in sizes.collect()}
    assert got == brute_components(rows, n, p, q)


def test_ngram_join_odd(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (2, "A B c d e f"), (3, None)], "doc_id long, text string")
    found, sizes = ngram_join.link_components(df)
    assert {r["id"]: r["root"] for r in found.collect()} == {1: 1, 2: 1} and sizes.count() == 5
    found, sizes = ngram_join.link_components(df.limit(0))
    assert found.count() == 0 and sizes.count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 90, 90: 90, 95: 90}


# ----------------------------------------------------------------------- rules


def test_rules(spark):
    rows = corpus() + [(500, "x y z x y z\nx y z x y z\n#% &"), (501, "SHOUT! " * 60)]
    led = rules.apply_policy(rules.ledger(frame(spark, rows)))
    got = {r["doc_id"]: r for r in led.collect()}
    for i, t in rows:
        t = t or ""
        w = t.split()
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, x in enumerate(three) if three.count(x) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.split()]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in t))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(hit))
        assert bool(r["fail_bits"] & rules.BASE.hard) == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    table = {r["rule"]: r for r in rules.ablations(led).collect()}
    assert table["few_words"]["n_failed"] == sum(bool(r["fail_bits"] & 1) for r in got.values())
    assert rules.ledger(frame(spark, rows).limit(0)).count() == 0
