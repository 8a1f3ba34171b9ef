"""Line dedup with a log-template tree.

Lines are parsed as log messages are. Tokens that are variable by nature
(anything with a digit) become ``<*>``. A tree of fixed depth routes a line by
its token count and its leading tokens to a leaf; within a leaf a line joins
the template that it shares most tokens with, if that is at least ``SIMILAR``
of them, and positions where they differ become ``<*>`` too. Templates that
occur in many documents are boilerplate, and their lines are dropped.

At scale only leaves that enough documents reach can hold such a template.
So leaves are counted first (two hashes a line, combined before the shuffle),
then the distinct lines of those leaves alone are parsed, each leaf as a
sorted stream, so the outcome does not depend on how rows were dealt. A leaf's
templates are found through an index of their tokens by position, not by
comparing all of them. A leaf with more than ``SLICE`` distinct lines is parsed
in slices, and their templates are parsed once more as lines are, so no leaf is
one long task. Joins on leaves and templates salt the keys that hold many rows.

Copies of a document count as one document, so that copies alone make no line
boilerplate; they are left to document-level deduplication. Copies are told by
the smallest hashes of five-word shingles (:func:`copies_of`). All other
recurring lines go, whatever share of a document they are. Longer lines need
fewer documents (:func:`_enough`); one that stands in several, but in too few
to be boilerplate at any length, stays in the first of them.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.common import Text, chunks, join_salted, lean, materialize, read_table, record_batches
from lexigrove.llm.components import components
from lexigrove.llm.ngram_join import shingle_sets

#: Leading tokens that route a line, below its token count.
DEPTH = 3
SIMILAR = 0.8
#: Documents in which a template occurs before it counts as boilerplate.
MIN_DOCS = 10
#: Up to the first number of tokens ``MIN_DOCS`` documents are needed, from the second on ``LONG_DOCS``, as such a line
#: does not recur by chance; between them the number falls evenly, by one document a token with these values.
SHORT_WORDS, LONG_WORDS, LONG_DOCS = 42, 50, 2
#: Distinct lines of a leaf that are parsed in one stream.
SLICE = 2_000
#: Bits of the filter that keeps lines of rare leaves from travelling; its size is the same for any corpus.
FILTER_BITS = 1 << 24
#: Smallest shingle hashes kept of a document, those that look for its copies, and the estimated similarity of copies
#: (0.8 less about two standard errors of the estimate).
SKETCH, KEYS, COPIES = 64, 8, 0.7

_LINES = "doc_id long, pos int, tokens int, leaf long"
_LINES_MASK = _LINES + ", mask_hash long, mask string"
_DIGITS = b"0123456789"


def masked(tokens: list[bytes]) -> list[bytes]:
    """Tokens of a line, those with a digit as ``<*>``."""
    return [t if t.isalpha() or len(t.translate(None, _DIGITS)) == len(t) else b"<*>" for t in tokens]


def _leaf_key(tokens: list[bytes]) -> bytes:
    """What routes a line, at any length: its token count and leading tokens."""
    return b"%d " % len(tokens) + b" ".join(masked(tokens[:DEPTH]))


def leaf_filter(leaves: DataFrame) -> bytes:
    """Bitmap of the leaves' hashes, folded to ``FILTER_BITS``; where it is full, it keeps nothing back."""
    bit = F.col("leaf").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = leaves.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(leaf & {FILTER_BITS - 1} & 63 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return out.astype("<i8").tobytes()


def lines_of(docs: DataFrame, with_mask: bool, only: bytes | None = None) -> DataFrame:
    """(doc_id, pos, tokens, leaf) of every line with a word; if wanted, its mask and the mask's hash.

    With ``only``, a :func:`leaf_filter`, lines whose leaf it does not hold may be left out.
    """

    def signed(data: bytes) -> int:
        return xxhash.xxh3_64_intdigest(data) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                ids, at, count, leaf, hashed, masks = [], [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    body = text.as_buffer()
                    for pos, line in enumerate((body.to_pybytes() if body is not None else b"").split(b"\n")):
                        split = line.split()
                        if split:
                            key = signed(_leaf_key(split))
                            if only is not None and not only[(key & FILTER_BITS - 1) >> 3] >> (key & 7) & 1:
                                continue
                            ids.append(doc_id)
                            at.append(pos)
                            count.append(len(split))
                            leaf.append(key)
                            if with_mask:
                                mask = b" ".join(masked(split))
                                hashed.append(signed(mask))
                                masks.append(mask)
                columns = [pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(count, pa.int32()), pa.array(leaf, pa.int64())]
                names = ["doc_id", "pos", "tokens", "leaf"]
                if with_mask:
                    columns += [pa.array(hashed, pa.int64()), pa.array(masks, pa.binary()).cast(pa.string())]
                    names += ["mask_hash", "mask"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _LINES_MASK if with_mask else _LINES)


class Leaf:
    """Templates of one leaf: lists of tokens, ``<*>`` where they vary."""

    def __init__(self, similar: float = SIMILAR):
        self.similar = similar
        self.templates: list[list[str]] = []
        self.index: dict[tuple[int, str], list[int]] = defaultdict(list)

    def add(self, tokens: list[str]) -> int:
        """Join the most similar template (the earliest of equals) or found one."""
        n = len(tokens)
        shared: Counter[int] = Counter()
        # A template that shares the least number of tokens also shares one of
        # any (n - least + 1) positions: candidates come from the rarest entries.
        least = max(1, -(-int(n * self.similar * 1000) // 1000))
        slots = sorted(((len(self.index.get((i, w), ())), i) for i, w in enumerate(tokens)))[: n - least + 1]
        for t in {t for _, i in slots for t in self.index.get((i, tokens[i]), ())}:
            same = sum(a == b for a, b in zip(self.templates[t], tokens, strict=True))
            if same >= self.similar * n:
                shared[t] = same
        if shared:
            best = max(shared.items(), key=lambda x: (x[1], -x[0]))[0]
            template = self.templates[best]
            for i, (a, b) in enumerate(zip(template, tokens, strict=True)):
                if a != b and a != "<*>":
                    template[i] = "<*>"
                    self.index[i, "<*>"].append(best)
            return best
        self.templates.append(list(tokens))
        t = len(self.templates) - 1
        for i, w in enumerate(tokens):
            self.index[i, w].append(t)
        return t


_OUT = "leaf long, mask_hash long, slice int, template long, text string"
_SCHEMA = pa.schema([("leaf", pa.int64()), ("mask_hash", pa.int64()), ("slice", pa.int32()), ("template", pa.int64()), ("text", pa.string())])


def _parsed(lines: DataFrame, similar: float) -> DataFrame:
    """(leaf, slice, mask, mask_hash) to the template of each line, parsed slice by slice in the order of the text.

    ``text`` is the template as it stands after the slice's last line, given with its first line only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            at, leaf, held = None, Leaf(similar), []

            def parsed() -> Iterator[dict]:
                seen: set[int] = set()
                for hashed, t in held:
                    first = t not in seen
                    seen.add(t)
                    yield {"leaf": at[0], "slice": at[1], "mask_hash": hashed, "template": t, "text": " ".join(leaf.templates[t]) if first else None}

            for batch in batches:
                for *key, mask, hashed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if key != at:
                        yield from parsed()
                        at, leaf, held = key, Leaf(similar), []
                    held.append((hashed, leaf.add(mask.split(" "))))
            yield from parsed()

        return record_batches(rows(), _SCHEMA, 10_000)

    dealt = lines.select("leaf", "slice", "mask", "mask_hash").repartition("leaf", "slice").sortWithinPartitions("leaf", "slice", "mask")
    return dealt.mapInArrow(lean(run), _OUT)


def templates_of(lines: DataFrame, similar: float = SIMILAR, slice_lines: int = SLICE) -> DataFrame:
    """(leaf, mask, mask_hash) of distinct lines to (leaf, mask_hash, template)."""
    sizes = materialize(lines.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > slice_lines))
    parts = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(slice_lines)).cast("int")
    sliced = join_salted(lines, sizes, ["leaf"], "n", "left", F.col("mask_hash")).withColumn("slice", F.pmod(F.xxhash64("mask_hash"), parts).cast("int"))
    first = materialize(_parsed(sliced, similar))
    ready = first.select("leaf", "mask_hash", "template")
    if not sizes.limit(1).count():
        return ready
    # The templates of the slices of a leaf are parsed together, as lines: the same text is one line.
    made = first.filter("text is not null").join(sizes.select("leaf"), "leaf", "left_semi").select("leaf", "slice", "template", F.col("text").alias("mask"), F.xxhash64("text").alias("text_hash"))
    again = made.groupBy("leaf", F.col("text_hash").alias("mask_hash")).agg(F.min("mask").alias("mask")).withColumn("slice", F.lit(0))
    merged = _parsed(again, similar).select("leaf", F.col("mask_hash").alias("text_hash"), F.col("template").alias("merged"))
    named = made.join(merged, ["leaf", "text_hash"]).select("leaf", "slice", "template", "merged")
    # Merged templates get numbers of their own below zero.
    weight = first.groupBy("leaf", "slice", "template").agg(F.count("*").alias("n"))
    named = materialize(named.join(weight, ["leaf", "slice", "template"]))
    out = join_salted(first.select("leaf", "slice", "mask_hash", "template"), named, ["leaf", "slice", "template"], "n", "left", F.col("mask_hash"))
    return out.select("leaf", "mask_hash", F.when(F.col("merged").isNull(), F.col("template")).otherwise(-1 - F.col("merged")).alias("template"))


def _enough(docs: str, min_docs: int, tokens: str = "tokens") -> Column:
    """So many documents make a line of so many tokens recurring."""
    least = min(LONG_DOCS, min_docs)
    down = F.ceil((F.lit(LONG_WORDS) - F.col(tokens)) * F.lit((min_docs - least) / (LONG_WORDS - SHORT_WORDS)))
    return F.col(docs) >= F.least(F.lit(min_docs), F.greatest(F.lit(least), least + down))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, slice_lines: int = SLICE) -> DataFrame:
    """(doc_id, pos, tokens, leaf, template, docs) of every line whose template occurs in enough documents: :func:`_enough`."""
    leaves = lines_of(docs, False).select("doc_id", "leaf", "tokens").distinct().groupBy("leaf").agg(F.count("*").alias("docs"), F.max("tokens").alias("tokens"))
    leaves = materialize(leaves.filter(_enough("docs", min_docs)).select("leaf", "docs"))
    dealt = F.col("doc_id")
    candidates = materialize(join_salted(lines_of(docs, True, leaf_filter(leaves)), leaves, ["leaf"], "docs", "inner", dealt).select("doc_id", "pos", "leaf", "mask_hash", "mask", "tokens"))
    distinct = materialize(candidates.groupBy("leaf", "mask_hash").agg(F.min("mask").alias("mask"), F.count("*").alias("n")))
    known = templates_of(distinct.drop("n"), slice_lines=slice_lines).join(distinct.select("leaf", "mask_hash", "n"), ["leaf", "mask_hash"])
    placed = materialize(join_salted(candidates.drop("mask"), materialize(known), ["leaf", "mask_hash"], "n", "inner", dealt).select("doc_id", "pos", "leaf", "template", "tokens"))
    counts = placed.select("doc_id", "leaf", "template", "tokens").distinct().groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.max("tokens").alias("most"))
    counts = materialize(counts.filter(_enough("docs", min_docs, "most")).select("leaf", "template", "docs"))
    return join_salted(placed, counts, ["leaf", "template"], "docs", "inner", dealt).select("doc_id", "pos", "tokens", "leaf", "template", "docs")


def sketches_of(docs: DataFrame) -> DataFrame:
    """(doc_id, sketch) of every row: the smallest hashes (31 bits, ascending) of its distinct five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                made = [(s[:SKETCH] >> np.uint64(33)).astype(np.int64) for s in shingle_sets(Text(part.column(1)), 5)]
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int32), pa.array(np.concatenate(made).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, sketch array<int>")


def likeness(a: str, b: str) -> Column:
    """Similarity that two sketches tell: the share of both in the smallest hashes of either."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(union, F.col(a)), F.col(b))) / F.greatest(F.lit(1), F.size(union))


def copies_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, root) of the documents among ``ids`` that have copies; the root is the smallest of them.

    Equal sketches are one member first. A member is compared with the most
    central one that each of a few of its hashes leads to, the one whose hashes
    most members have: of a document and its edited copies, the document. So
    the pairs grow with the members, not with the square of a group.
    """
    # Ids grow with the corpus, so neither side is broadcast, at any size.
    sketches = materialize(sketches_of(docs).join(ids.hint("merge"), "doc_id", "left_semi").filter(F.size("sketch") > 0).withColumn("same", F.xxhash64("sketch")))
    members = materialize(sketches.groupBy("same").agg(F.min("doc_id").alias("id"), F.min("sketch").alias("sketch"), F.count("*").alias("n")))
    by_hash = materialize(members.select("id", F.explode(F.slice("sketch", 1, KEYS)).alias("h")))
    known = materialize(by_hash.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    rated = materialize(join_salted(by_hash, known, ["h"], "n", "inner", F.col("id")).select("id", "h", "n"))
    rank = rated.groupBy("id").agg(F.sum(F.log("n")).alias("central"))
    rated = rated.join(rank, "id")
    centre = materialize(rated.groupBy("h").agg(F.max(F.struct("central", (-F.col("id")).alias("low"))).alias("top"), F.count("*").alias("n")).select("h", (-F.col("top.low")).alias("centre"), "n"))
    led = join_salted(rated.select("id", "h"), centre, ["h"], "n", "inner", F.col("id")).filter("id <> centre")
    pairs = led.groupBy("id", "centre").agg(F.count("*").alias("votes"))
    own = members.select("id", F.col("sketch").alias("mine"))
    pairs = pairs.join(own.hint("merge"), "id").filter(F.col("votes") * 4 >= F.least(F.size("mine"), F.lit(KEYS)))
    weight = materialize(pairs.groupBy("centre").agg(F.count("*").alias("n")))
    theirs = materialize(weight.join(members.select(F.col("id").alias("centre"), F.col("sketch").alias("other")), "centre"))
    edges = join_salted(pairs, theirs, ["centre"], "n", "inner", F.col("id")).filter(likeness("mine", "other") >= COPIES)
    tied = edges.select(F.col("id").alias("a"), F.col("centre").alias("b"))
    equal = materialize(members.filter("n > 1").select("same", F.col("id").alias("first"), "n"))
    copies = join_salted(sketches.select("doc_id", "same"), equal, ["same"], "n", "inner", F.col("doc_id")).filter("doc_id <> first")
    return components(tied.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, slice_lines: int = SLICE) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the text without recurring lines.

    Lines are split at line feeds; lines without a word are never dropped.
    Null texts stay null and have no lines; null ids are left whole; rows of
    one id are one document: a row loses the positions found for any of them
    that it has. Other columns pass through (``n_lines`` and ``n_dropped`` are
    replaced); an empty table stays empty.
    """
    known = docs.filter("doc_id is not null")
    found = materialize(recurring_lines(known, min_docs, slice_lines))
    copies = copies_of(known, found.select("doc_id").distinct())
    grouped = found.join(copies.hint("merge"), found["doc_id"] == copies["id"], "left").withColumn("group", F.coalesce("root", "doc_id")).drop("id", "root")
    grouped = materialize(grouped)
    counts = grouped.select("leaf", "template", "tokens", "group", "docs").distinct().groupBy("leaf", "template")
    counts = counts.agg(F.count("*").alias("groups"), F.max("tokens").alias("most"), F.min("group").alias("first"), F.max("docs").alias("n"))
    counts = materialize(counts.filter(_enough("groups", min_docs, "most")).drop("most"))
    hits = join_salted(grouped.drop("docs"), counts, ["leaf", "template"], "n", "inner", F.col("doc_id"))
    hits = hits.filter((F.col("groups") >= min_docs) | (F.col("group") != F.col("first")))
    drops = hits.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("drop_pos")).withColumnRenamed("doc_id", "drop_id")
    kept = docs.drop("n_lines", "n_dropped")
    joined = kept.join(drops, kept["doc_id"].cast("long") == drops["drop_id"], "left")
    split = F.split("text", "\n", -1)
    joined = joined.withColumns({"__lines": split, "__gone": F.filter("drop_pos", lambda x: x < F.size(split))})
    apply = F.size("__gone") > 0
    # What lies between dropped lines, run by run.
    edges = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size("__lines")))
    runs = F.transform(F.sequence(F.lit(0), F.size("__gone")), lambda i: F.slice("__lines", F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1))
    left = F.array_join(F.flatten(runs), "\n")
    return joined.select(
        *[F.when(apply, left).otherwise(F.col("text")).alias("text") if c == "text" else kept[c] for c in kept.columns],
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(apply, F.size("__gone")).otherwise(0).cast("long").alias("n_dropped"),
    )


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: lines, lines dropped, and a digest of the text that is left."""
    out = drop_recurring(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their recurring lines; ``n_chars`` follows the text.

    Null, empty and repeated rows, null ids and an empty table: as in
    :func:`drop_recurring`; other columns pass through.
    """
    out = drop_recurring(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
