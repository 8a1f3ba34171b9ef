"""Similarity of texts and identifiers: n-gram leakage, token sets, fuzzy ids, reference repair."""

from __future__ import annotations

import difflib
import heapq
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrove.functions.text import word_ngrams


#: Bits of the n-gram filter for each n-gram of the smaller side, at most, and bits of one of its rows.
FILTER_BITS, MOST_BITS, ROW_BITS = 32, 1 << 28, 4096


def seen_filter(values: DataFrame, column: str) -> DataFrame:
    """(row, words): a Bloom filter of the values' hashes as rows of 64 words, 37 MB of them at most at any number of values.

    Beyond that bound it lets more through, and never holds a value back.
    """
    n = values.count()
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (FILTER_BITS * max(n, 1) - 1).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    word = values.select(F.floor(at / 64).alias("word"), (at % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set"))
    rows = word.groupBy(F.floor(F.col("word") / (ROW_BITS // 64)).alias("row")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % (ROW_BITS // 64)).cast("int").alias("k"), "set"))).alias("m"))
    words = F.transform(F.sequence(F.lit(0), F.lit(ROW_BITS // 64 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))
    return rows.select("row", words.alias("words"), F.lit(bits).alias("bits"))


def maybe_seen(rows: DataFrame, column: str, seen: DataFrame) -> DataFrame:
    """Rows whose value a :func:`seen_filter` may hold, told where they are: no shuffle, no Python."""
    bits = seen.select(F.max("bits")).first()[0]
    if bits is None:
        return rows.limit(0)
    at = rows.withColumn("__at", F.pmod(F.xxhash64(column), F.lit(bits)))
    filters = F.broadcast(seen.select(F.col("row").alias("__row"), F.col("words").alias("__words")))
    met = at.join(filters, F.floor(F.col("__at") / ROW_BITS) == F.col("__row"))
    is_set = F.expr(f"(element_at(__words, cast(floor(__at % {ROW_BITS} / 64) as int) + 1) & shiftleft(1L, cast(__at % 64 as int))) <> 0")
    return met.filter(is_set).drop("__at", "__row", "__words")


def leakage(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float = 0.4, n: int = 3, text: str = "text") -> DataFrame:
    """(left_key, right_key, jaccard) of pairs whose word n-gram sets have this similarity or more.

    ``right`` is the smaller side. A Bloom filter of its n-grams is applied
    where ``left`` is read, so what is shuffled follows the smaller side: its
    n-grams and those of ``left`` that are, but for a few, among them. Of the
    n-grams that both have, candidates share one among the rarest of both sets:
    two sets of this similarity share more n-grams than lie beyond these
    prefixes, so none is lost, and common n-grams are not joined on.
    """
    from lexigrove.sources.scratch import cut

    def grams(df: DataFrame, key: str) -> DataFrame:
        listed = df.select(F.col(key).alias("key"), word_ngrams(F.col(text), n).alias("grams"))
        return listed.select("key", F.size("grams").alias("n"), F.explode("grams").alias("gram"))

    few = cut(grams(right, right_key), "grams")
    seen = cut(seen_filter(few.select("gram").distinct(), "gram"), "filter")
    many = cut(maybe_seen(grams(left, left_key), "gram", seen), "grams")
    every = many.withColumn("side", F.lit(0)).unionByName(few.withColumn("side", F.lit(1)))
    # An n-gram that one side lacks joins nothing; its place in the order is free, and last.
    rare = every.groupBy("gram").agg(F.count("*").alias("df"), F.count_distinct("side").alias("sides")).filter("sides = 2").select("gram", "df")
    placed = every.join(rare, "gram").groupBy("side", "key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("shared"))
    sets = cut(placed.select("side", "key", "n", F.transform("shared", lambda x: x["gram"]).alias("shared")), "sets")
    # What is in one side only takes up room of what may be left out.
    prefix = F.size("shared") - F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-9)).cast("int") + 1
    keyed = sets.select("side", "key", F.explode(F.slice("shared", 1, F.greatest(F.lit(0), prefix))).alias("gram"))
    side = lambda df, k, name, other: df.filter(F.col("side") == k).select(F.col("key").alias(name), *other)
    pairs = side(keyed, 0, left_key, [F.col("gram").alias("__gram")]).join(side(keyed, 1, right_key, [F.col("gram").alias("__gram")]), "__gram").select(left_key, right_key).distinct()
    both = pairs.join(side(sets, 0, left_key, [F.col("n").alias("__na"), F.col("shared").alias("__a")]), left_key).join(side(sets, 1, right_key, [F.col("n").alias("__nb"), F.col("shared").alias("__b")]), right_key)
    common = F.size(F.array_intersect("__a", "__b"))
    similarity = common / (F.col("__na") + F.col("__nb") - common)
    return both.filter(similarity >= threshold).select(left_key, right_key, F.round(similarity, 3).alias("jaccard"))


def clean_nodes(leaks: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Nodes of which no example leaks."""
    return nodes.join(leaks.select(key).distinct(), key, "left_anti")


def _tokens(name: str):
    return F.array_distinct(F.filter(F.split(name, "_"), lambda x: F.length(x) >= 3))


def token_jaccard_pairs(names: DataFrame, name: str, threshold: float = 0.3) -> DataFrame:
    """(a, b, jaccard) of different names, a < b, by their underscore-separated tokens of three letters or more."""
    t = names.select(F.col(name).alias("name"), _tokens(name).alias("w")).select("name", F.size("w").alias("n"), F.explode("w").alias("x"))
    a, b = t.select(F.col("name").alias("a"), F.col("n").alias("na"), "x"), t.select(F.col("name").alias("b"), F.col("n").alias("nb"), "x")
    shared = a.join(b, "x").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return shared.withColumn("j", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).filter(F.col("j") >= threshold).select("a", "b", F.round("j", 6).alias("jaccard"))


#: Ids and references that one task compares.
ID_BLOCK, REF_BLOCK = 20_000, 2_000


def _of_like_letters(known: list[str], asked: list[str], cutoff: float) -> Callable[[str], list[str]]:
    """For each of ``asked``, those of ``known`` whose letters in common allow a sequence ratio of ``cutoff``.

    Strings of the same letters, in whatever order, are one class; references
    are held against classes as vectors of counts, once for all of their own.
    """
    spelt = lambda x: "".join(sorted(x))
    classes: dict[str, list[str]] = {}
    for x in known:
        classes.setdefault(spelt(x), []).append(x)
    letters = {c: i for i, c in enumerate(sorted({c for x in (*classes, *asked) for c in x}))}

    def counted(x: str) -> np.ndarray:
        return np.bincount([letters[c] for c in x], minlength=len(letters)).astype(np.int32)

    spellings = list(classes)
    vectors = np.array([counted(x) for x in spellings], dtype=np.int32).reshape(len(spellings), len(letters))
    sizes = vectors.sum(axis=1)
    done: dict[str, list[str]] = {}

    def close(ref: str) -> list[str]:
        spelling = spelt(ref)
        if spelling not in done:
            own = counted(ref)
            used = np.flatnonzero(own)
            common = np.minimum(vectors[:, used], own[used]).sum(axis=1)
            hits = np.flatnonzero(2 * common >= cutoff * (sizes + len(ref)))
            done[spelling] = [x for k in hits for x in classes[spellings[k]]]
        return done[spelling]

    return close


def fuzzy_match(refs: DataFrame, ids: DataFrame, most: int = 3, cutoff: float = 0.7, min_substring: int = 4, min_jaccard: float = 0.3) -> DataFrame:
    """(ref, id, place): the best ids of each reference, by three rules in turn.

    1. One contains the other (both of ``min_substring`` letters or more), by
    sequence ratio; 2. token Jaccard; 3. closest by sequence ratio of
    ``cutoff`` or more. A sequence ratio has no key to join on, so the
    references (a query set) meet the ids block by block, each task keeping a
    few of each rule; no list of either side is sent to all workers. Within a
    block, letters in a row, tokens and counts of letters tell which pairs are
    compared at all.
    """
    words = lambda s: {x for x in s.split("_") if len(x) >= 3}
    grams = lambda s: {s[i : i + min_substring] for i in range(len(s) - min_substring + 1)}
    keep = 3 * most

    def listed(pairs: Iterable[tuple[str, int]]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for x, k in pairs:
            out.setdefault(x, []).append(k)
        return out

    def compared(known: list[str], asked: list[str]) -> Iterator[tuple[str, int, float, str]]:
        """Candidates of each rule are found by what they must share, and then compared."""
        holding = listed((g, k) for k, x in enumerate(known) for g in grams(x))
        # An id within a reference brings its rarest letters with it, one within an id likewise.
        within = listed((min(g, key=lambda y: len(holding[y])), k) for k, x in enumerate(known) if (g := grams(x)))
        tokens = [words(x) for x in known]
        having = listed((w, k) for k, own in enumerate(tokens) for w in own)
        close = _of_like_letters(known, asked, cutoff)
        for ref in asked:
            own, told = grams(ref), words(ref)
            maybe = {k for g in own for k in within.get(g, ())}
            if own:
                maybe.update(min((holding.get(g, []) for g in own), key=len))
            inside = [(difflib.SequenceMatcher(None, ref, known[k]).ratio(), known[k]) for k in maybe if ref in known[k] or known[k] in ref]
            shared = Counter(k for w in told for k in having.get(w, ()))
            alike = [(n / (len(told) + len(tokens[k]) - n), known[k]) for k, n in shared.items() if n >= min_jaccard * (len(told) + len(tokens[k]) - n)]
            for rule, found in enumerate((inside, alike)):
                yield from ((ref, rule, r, x) for r, x in heapq.nsmallest(keep, found, key=lambda p: (-p[0], p[1])))
            matcher = difflib.SequenceMatcher(None, "", ref)
            ratios = []
            for x in close(ref):
                matcher.set_seq1(x)
                if (ratio := matcher.ratio()) >= cutoff:
                    ratios.append((ratio, x))
            yield from ((ref, 2, r, x) for r, x in heapq.nlargest(keep, ratios))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for known, asked in zip(frame["ids"], frame["refs"], strict=True):
                rows = list(compared(list(known), list(asked)))
                yield pd.DataFrame(rows, columns=["ref", "rule", "score", "id"]).astype({"rule": "int32", "score": "float64"})

    def blocked(df: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
        rows = df.filter(F.col(name).isNotNull() & (F.col(name) != "")).select(name).distinct()
        n = max(1, -(-rows.count() // size))
        return rows.groupBy(F.pmod(F.xxhash64(name), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(name).alias(f"{name}s")), n

    id_blocks, _ = blocked(ids, "id", ID_BLOCK)
    ref_blocks, n = blocked(refs, "ref", REF_BLOCK)
    dealt = id_blocks.withColumn("ref_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(ref_blocks, "ref_block")
    dealt = dealt.select("ids", "refs", "id_block", "ref_block").repartition("id_block", "ref_block")
    found = dealt.mapInPandas(run, "ref string, rule int, score double, id string")
    # The closest ids come in the order that ties to the larger one, and are cut before they meet the other rules.
    tie = F.when(F.col("rule") == 2, F.col("id"))
    by_rule = Window.partitionBy("ref", "rule").orderBy(F.col("score").desc(), tie.desc(), F.col("id").asc())
    found = found.withColumn("n", F.row_number().over(by_rule)).filter((F.col("rule") < 2) | (F.col("n") <= most))
    once = found.groupBy("ref", "id").agg(F.min(F.struct("rule", "n")).alias("first"))
    place = F.row_number().over(Window.partitionBy("ref").orderBy("first"))
    return once.select("ref", "id", place.alias("place")).filter(F.col("place") <= most)


def repair_references(refs: DataFrame, ids: DataFrame, judged: DataFrame) -> DataFrame:
    """(id, related, broken, by_match, by_judge): references that exist, in order, each once, never the node itself.

    ``refs`` gives (id, pos, ref); ``judged`` (ref, answer) holds a judge's
    mapping for what matching cannot resolve, valid if the answer is an id.
    """
    known = ids.select(F.col("id").alias("ref"), F.lit(True).alias("ok"))
    told = refs.join(known, "ref", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    matched = fuzzy_match(told.filter(~F.col("ok")).select("ref").distinct(), ids, 1).select("ref", F.col("id").alias("matched"))
    answers = judged.join(ids.select(F.col("id").alias("answer")), "answer", "left_semi").select("ref", "answer")
    out = told.join(matched, "ref", "left").join(answers, "ref", "left")
    out = out.withColumn("target", F.when(F.col("ok"), F.col("ref")).otherwise(F.coalesce("matched", "answer"))).withColumn("target", F.when(F.col("target") != F.col("id"), F.col("target")))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("pos", "target")))), lambda s: s["target"])
    kinds = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("ref"))))
    return out.groupBy("id").agg(
        F.array_distinct(listed).alias("related"), kinds(~F.col("ok")).alias("broken"),
        kinds(~F.col("ok") & F.col("matched").isNotNull()).alias("by_match"), kinds(~F.col("ok") & F.col("matched").isNull() & F.col("answer").isNotNull()).alias("by_judge"),
    )


def first_by_name(nodes: DataFrame, names: DataFrame, files: DataFrame) -> DataFrame:
    """First node (by place) of each wanted name within the wanted files: (name, id)."""
    w = Window.partitionBy("name").orderBy("pos")
    return nodes.join(names, "name", "left_semi").join(files, "file", "left_semi").withColumn("n", F.row_number().over(w)).filter("n = 1").select("name", "id")
