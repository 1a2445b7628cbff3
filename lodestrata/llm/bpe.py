"""Byte-level BPE encoding and decoding with a contiguous rank array for each word.

A word keeps its parts, by id, between contiguous boundaries, and beside them the ranks of adjacent parts. The least
rank is found by a scan, the boundary it stands for is deleted, and the ranks of its two neighbours are looked up
anew. Words longer than LONG bytes use a heap of the same ranks instead, so that one very long word is not quadratic;
the result is the same.

Defined results: a null text is empty, with no ids and an empty decoded text; each input row gives one output row,
repeated or not; null ids pass through. Strings of added tokens in a text become those tokens. Texts are never cut.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.shared import map_rows

#: Bytes of a word from which the heap is used.
LONG = 256
#: Words kept encoded in a Python worker, in each of two generations.
CACHED = 300_000
NONE = 1 << 60
#: Bits of an id within a pair's number.
SHIFT = 24
#: How the byte-level pre-tokenizer cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """Ids of the words met so far. Beyond the limit the older generation goes, so memory is bounded."""

    def __init__(self, encode, limit: int = CACHED):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if (ids := self.old.get(word)) is None:
            ids = tuple(self.encode(word.encode("utf-8")))
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Codec:
    """Reads a tokenizer file of kind byte-level BPE."""

    def __init__(self, path: str):
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        letters, vocab = _byte_letters(), told["model"]["vocab"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        added = {t["content"]: t["id"] for t in told.get("added_tokens", ())}
        self.ids = {as_bytes(t): i for t, i in vocab.items() if t not in added}
        self.pieces = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        for token, i in added.items():
            self.pieces[i] = token.encode("utf-8")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"])
        pairs = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        #: The rank of a pair of ids, by one number; the id that the merge of each rank makes.
        self.ranks = {self.ids[a] << SHIFT | self.ids[b]: n for n, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.find = regex.compile(PATTERN).findall
        self.words = Words(self.encode_word)

    def encode_word(self, word: bytes) -> list[int]:
        return self._by_heap(word) if len(word) > LONG else self._by_scan(word)

    def _by_scan(self, word: bytes) -> list[int]:
        rank, made = self.ranks.get, self.made
        parts = list(map(self.bytes.__getitem__, word))
        ranks = [rank(a << SHIFT | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NONE:
            at = ranks.index(least)
            parts[at] = part = made[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << SHIFT | part, NONE)
            if at < len(ranks):
                ranks[at] = rank(part << SHIFT | parts[at + 1], NONE)
        return parts

    def _by_heap(self, word: bytes) -> list[int]:
        """Parts stay where their first byte is, linked to the next and the one before; old entries are passed over."""
        n, rank = len(word), self.ranks.get
        parts = list(map(self.bytes.__getitem__, word))
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << SHIFT | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            least, start, left, right = heapq.heappop(heap)
            mid = after[start]
            if parts[start] != left or mid >= n or parts[mid] != right:
                continue
            end = after[mid]
            parts[start], parts[mid], after[start] = self.made[least], None, end
            if end < n:
                before[end] = start
            for a, b in ((before[start], start), (start, end)):
                if a >= 0 and b < n and (r := rank(parts[a] << SHIFT | parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    def encode(self, text: str) -> list[int]:
        if self.split_added is not None and any(token in text for token in self.added):
            parts = self.split_added.split(text)
            return [i for part in parts for i in ([self.added[part]] if part in self.added else chain.from_iterable(map(self.words.__getitem__, self.find(part))))]
        return list(chain.from_iterable(map(self.words.__getitem__, self.find(text))))

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One for each file in a Python worker, which keeps it, and the words it has met, from task to task."""
    return Codec(path)


def _list_of(ids: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))))


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """doc_id, ids and, decoded from those ids alone, text_again for each row of docs. path: a tokenizer file on all machines."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            ids = [codec.encode(t.as_py() or "") for t in batch.column("text")]
            again = [[pa.array(map(codec.decode, ids), pa.string())], ["text_again"]] if decoded else [[], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _list_of(ids), *again[0]], ["doc_id", "ids", *again[1]])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(plain, rows, "doc_id long, ids array<int>" + ", text_again string" * decoded)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text_again for each row (doc_id, ids); null ids are empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            again = [codec.decode(ids.as_py() or ()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(again, pa.string())], ["doc_id", "text_again"])

    return map_rows(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), rows, "doc_id long, text_again string")


def vocabulary() -> str:
    """The production vocabulary's file, as the machine's tokenizer package places it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, path: str) -> DataFrame:
    coded = encode_texts(docs, path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text_again").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
