import difflib
import random

from lexigrove.operators import similarity


def plainly(refs, ids, most=3, cutoff=0.7, least=4, min_jaccard=0.3):
    """The three rules by comparing every pair."""
    words = lambda s: {x for x in s.split("_") if len(x) >= 3}
    out = set()
    for ref in refs:
        inside = [(-difflib.SequenceMatcher(None, ref, x).ratio(), x) for x in ids if len(ref) >= least <= len(x) and (ref in x or x in ref)]
        alike = [(-len(words(ref) & words(x)) / len(words(ref) | words(x)), x) for x in ids if words(ref) & words(x) and len(words(ref) & words(x)) >= min_jaccard * len(words(ref) | words(x))]
        close = sorted(((r, x) for x in ids if (r := difflib.SequenceMatcher(None, x, ref).ratio()) >= cutoff), reverse=True)[:most]
        order = dict.fromkeys([x for _, x in sorted(inside)] + [x for _, x in sorted(alike)] + [x for _, x in close])
        out |= {(ref, x, n + 1) for n, x in enumerate(list(order)[:most])}
    return out


def test_fuzzy_match_equals_all_pairs(spark):
    rng = random.Random(5)
    name = lambda: "_".join(rng.choice(["red", "blue", "reader", "read", "ab", "node", "é1", "s77"]) for _ in range(rng.randint(1, 4)))
    ids = sorted({name() for _ in range(150)} | {f"s{i}" for i in range(40)})
    refs = sorted({name() + rng.choice(["", "x", "s", "_12"]) for _ in range(80)} | {"zzzz12", "s1", "ab", "21s"})
    rows = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    assert {tuple(r) for r in similarity.fuzzy_match(rows(refs, "ref"), rows(ids, "id")).collect()} == plainly(refs, ids)


def test_classes_of_letters_tell_what_is_compared():
    close = similarity._of_like_letters([f"s{i}" for i in range(2_000)], ["zzzz1234", "s1234"], 0.7)
    assert close("zzzz1234") == [] and 0 < len(close("s1234")) < 500 and similarity._of_like_letters([], ["a"], 0.7)("a") == []
