"""Quality rules: a bitmask ledger.

Every rule is evaluated once. The ledger keeps each document's measurements
and one bit a rule that it fails. Policies are versioned: bits of which one
failure rejects, and bits of which a number of failures does. They read the
ledger alone, so a new policy or an ablation never touches the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.common import Text, chunks, read_table, sequences

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_loud", "longest_word")

#: Name and failing condition of each rule over the measurements; bit i is rule i.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 6 * word_chars"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "100 * n_upper > 50 * word_chars"),
    ("exclamations", "100 * n_loud > 10 * word_chars"),
    ("endless_word", "longest_word > 2000"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """``hard``: any failure rejects. ``soft``: ``allowed`` failures pass, more reject."""

    version: str
    hard: int
    soft: int = 0
    allowed: int = 0

    def rejects(self, bits: Column) -> Column:
        return (bits.bitwiseAND(F.lit(self.hard)) != 0) | (F.bit_count(bits.bitwiseAND(F.lit(self.soft))) > self.allowed)


BASE = Policy("base", BIT["few_words"] | BIT["repeated_words"])
POLICIES = {
    p.version: p
    for p in (
        BASE,
        Policy("2", BASE.hard | BIT["symbols"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"] | BIT["shouting"] | BIT["exclamations"]),
        Policy("3", BASE.hard | BIT["symbols"] | BIT["shouting"] | BIT["duplicate_lines"], BIT["short_words"] | BIT["long_words"] | BIT["exclamations"] | BIT["endless_word"], 1),
    )
}
CURRENT = "3"


def _byte_table(letters: str) -> np.ndarray:
    return np.isin(np.arange(256), list(letters.encode()))


_SYMBOL, _UPPER, _LOUD = _byte_table(SYMBOLS), _byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _byte_table("!")


def measure(text: Text) -> dict[str, np.ndarray]:
    """Measurements of each text of a chunk, by name."""
    n = text.n
    start, end, row = text.words()
    points = np.concatenate(([0], np.cumsum(text.code_points(), dtype=np.int64)))
    length = points[end] - points[start]
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": np.bincount(row, weights=length, minlength=n).astype(np.int64)}
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_loud", _LOUD)):
        out[name] = text.per_row(table[text.data])
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, length)
    out["longest_word"] = longest
    # Lines with a word, and those equal to an earlier one.
    ls, le, lrow = text.lines()
    before = np.searchsorted(start, ls)
    with_word = np.searchsorted(start, le) > before
    ls, le, lrow = ls[with_word], le[with_word], lrow[with_word]
    out["n_lines"] = np.bincount(lrow, minlength=n)
    out["n_dup_lines"] = np.bincount(lrow[_earlier(lrow, text.hashes(ls, le))], minlength=n)
    # Words of 3-word windows that stand in the text twice or more.
    marked = np.zeros(len(start) + 3, bool)
    first = np.flatnonzero(row[:-2] == row[2:]) if len(row) > 2 else np.zeros(0, np.int64)
    if len(first):
        window = sequences(text.hashes(start, end), first, 3)
        twice = first[_not_alone(row[first], window)]
        for j in range(3):
            marked[twice + j] = True
    out["n_repeat_words"] = np.bincount(row[marked[: len(row)]], minlength=n)
    return {k: out[k].astype(np.int64) for k in MEASURES}


def _order(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, row))
    a, b = order[1:], order[:-1]
    return order, (key[a] == key[b]) & (row[a] == row[b])


def _earlier(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True for all but one of each group of equal (row, key)."""
    out = np.zeros(len(key), bool)
    if len(key) > 1:
        order, same = _order(row, key)
        out[order[1:]] = same
    return out


def _not_alone(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where another entry has the same (row, key)."""
    out = np.zeros(len(key), bool)
    if len(key) > 1:
        order, same = _order(row, key)
        out[order[1:]] = same
        out[order[:-1]] |= same
    return out


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: its key, all measurements and ``fail_bits``.

    Whole texts are measured; null texts have no words. Repeated rows stay,
    null keys stay, other columns are ignored, an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, batch.schema.names[1]):
                found = measure(Text(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[m]) for m in MEASURES)], names=[key, *MEASURES])

    measured = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledger_rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with the verdict of one policy."""
    return ledger_rows.withColumn("policy", F.lit(version)).withColumn("kept", ~POLICIES[version].rejects(F.col("fail_bits")))


def ablations(ledger_rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and that only it rejects.

    One pass over the ledger: every rule's counts are conditional sums over the
    bits with that rule's bit cleared.
    """
    p = POLICIES[version]
    bits = F.col("fail_bits")
    sums = []
    for name, bit in BIT.items():
        if bit & (p.hard | p.soft):
            cleared = bits.bitwiseAND(F.lit(~bit))
            sums += [F.sum((bits.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"f_{name}"), F.sum((p.rejects(bits) & ~p.rejects(cleared)).cast("long")).alias(f"o_{name}")]
    row = ledger_rows.agg(*sums)
    used = [n for n, bit in BIT.items() if bit & (p.hard | p.soft)]
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"f_{n}"), F.lit(0)).alias("n_failed"), F.coalesce(F.col(f"o_{n}"), F.lit(0)).alias("n_rejected_alone")) for n in used))
    return row.select(F.inline(pairs))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the base verdict and the current policy's."""
    rows = apply_policy(ledger(read_table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        BASE.rejects(F.col("fail_bits")).alias("base_failed"), "kept", "fail_bits", "policy",
    )


_BITS_SQL = " | ".join(f"(CASE WHEN {c} THEN {BIT[n]} ELSE 0 END)" for n, c in RULES)
_P = POLICIES[CURRENT]
OP10_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
), threes AS (
  SELECT doc_id, i, word, lead(word, 1) OVER o AS word2, lead(word, 2) OVER o AS word3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), counted AS (
  SELECT doc_id, i, word3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, word2, word3) > 1 AS twice FROM threes
), marked AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT doc_id, twice OR lag(twice, 1, false) OVER o OR lag(twice, 2, false) OVER o AS hit FROM counted WINDOW o AS (PARTITION BY doc_id ORDER BY i)
  ) WHERE hit GROUP BY doc_id
), per_word AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, max(length(word)) AS longest_word FROM words GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line
), per_line AS (
  SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines FROM lines GROUP BY doc_id
), ledger AS (
  SELECT d.doc_id, coalesce(w.n_words, 0) AS n_words, coalesce(w.word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words, coalesce(l.n_lines, 0)::BIGINT AS n_lines,
         length(regexp_replace(coalesce(d.text, ''), '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(coalesce(d.text, ''), '[^!]', '', 'g')) AS n_loud,
         coalesce(w.longest_word, 0) AS longest_word
  FROM documents d LEFT JOIN per_word w USING (doc_id) LEFT JOIN per_line l USING (doc_id) LEFT JOIN marked m USING (doc_id)
), bits AS (
  SELECT *, ({_BITS_SQL})::BIGINT AS fail_bits FROM ledger
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE.hard}) <> 0 AS base_failed,
       NOT ((fail_bits & {_P.hard}) <> 0 OR bit_count(fail_bits & {_P.soft}) > {_P.allowed}) AS kept, fail_bits, '{CURRENT}' AS policy
FROM bits
"""
