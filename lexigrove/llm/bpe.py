"""BPE encoding and decoding with a contiguous rank array.

A text is cut into words; each distinct word is encoded once a worker and kept
in a bounded memory. A word holds its part boundaries and, beside them, the
rank of each pair of adjacent parts. The lowest rank is found by a scan, the
boundary between the two parts is deleted, and the two neighbouring ranks are
refreshed, until no pair has a rank. Words above ``SHORT`` bytes keep the same
ranks in a heap, since scanning would be quadratic.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm.common import chunks, lean, read_table, with_fields

#: Bytes of a word up to which ranks are scanned.
SHORT = 256
#: Distinct words that a worker remembers.
REMEMBERED = 200_000
NEVER = 1 << 60

#: Fixed value: the word pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Letter by which a vocabulary file writes each byte: printable ones stand for themselves, others follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of a byte-level BPE tokenizer file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.pieces = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.of_byte = [0] * 256
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = n
            self.merged.append(vocab[a + b])
        self.special = {}
        for t in spec.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that take in their surroundings are not supported")
            self.special[t["content"]] = t["id"]
            self.pieces[t["id"]] = t["content"].encode()
        self.cut = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.written = {i: str(i) for i in self.pieces}
        self.memory: dict[str, tuple[int, ...]] = {}

    def encode_word(self, word: bytes) -> tuple[list[int], list[int]]:
        """Ids of a word's parts and the boundaries of these parts."""
        if len(word) > SHORT:
            return self._encode_long(word)
        ids = [self.of_byte[b] for b in word]
        bounds = list(range(len(word) + 1))
        get = self.rank.get
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            ids[i] = self.merged[low]
            del ids[i + 1], bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
        return ids, bounds

    def _encode_long(self, word: bytes) -> tuple[list[int], list[int]]:
        n = len(word)
        ids: list[int | None] = [self.of_byte[b] for b in word]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[low], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        bounds = [i for i in range(n) if ids[i] is not None]
        return [ids[i] for i in bounds], [*bounds, n]

    def _ids(self, word: str) -> tuple[int, ...]:
        found = self.memory.get(word)
        if found is None:
            found = tuple(self.encode_word(word.encode("utf-8", "surrogatepass"))[0])
            if len(word) <= SHORT:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the strings of added tokens become their ids."""
        if self.cut is None or not self.cut.search(text):
            return list(chain.from_iterable(map(self._ids, self.words(text))))
        out: list[int] = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(self.special[part])
            else:
                out.extend(chain.from_iterable(map(self._ids, self.words(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec a worker and file."""
    return Codec(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_column(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of whole texts (null: empty); a column of that name is replaced.

    ``path`` names the tokenizer file on every executor.
    """
    kept = docs.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in chunks(batch, text, 500_000):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                made = pa.array([c.encode(t or "") for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, ids])

    return kept.mapInArrow(run, with_fields(kept, f"`{ids}` array<int>"))


def decode_column(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the texts of token ids (null: empty)."""
    kept = docs.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                made = pa.array([c.decode(x or []) for x in part.column(part.schema.get_field_index(ids)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, text])

    return kept.mapInArrow(run, with_fields(kept, f"`{text}` string"))


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids of whole texts and of what these ids decode to, in one pass.

    Null texts are empty (no ids); repeated rows stay; other columns are
    ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(c.written.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents, encoded and decoded."""
    return round_trips(read_table(spark, sf_dir, "documents"), path or tokenizer_path())


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: token counts and digests of what the mix holds.

    Null texts are encoded as empty ones; each row, repeated ones and null ids
    included, gives a row; other columns are left out; an empty table gives none.
    """
    return round_trips(docs, tokenizer_path())
