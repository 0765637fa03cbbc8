"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one resolves a whole pre-token that is itself a vocabulary entry through a minimal perfect hash (bucketed
displacements over two CRCs of the bytes; every slot holds one entry, and the stored key is compared).  Tier two
merges the rest: the bytes form a linked list, and a heap of (rank, position) takes the lowest-ranked pair next.

The vocabulary is read on the driver (its size is checked) and shipped with the task closure, so executors need no
vocabulary file.  Encoding is map-only: no shuffle, one pass over the texts, a bounded memo of pre-tokens per task.

Null texts are empty; an empty text has no ids.  Rows with a null doc_id or repeated rows are encoded like others,
and extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary beyond this many bytes of tokens is refused: it travels with every task.
MAX_VOCABULARY_BYTES = 64 << 20
#: Distinct pre-tokens that a Python worker remembers, over its tasks; the memo is emptied when full.
MEMO_ENTRIES = 250_000
_KEYS_A_BUCKET = 2
#: For this pattern, texts of only these letters, digits and signs are cut alike by a plainer pattern, which the
#: standard library matches in half the time.
_COMMON = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN_TEXT = re.compile("[\t\n\r -~À-ɏ]*").fullmatch
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-ZÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\s0-9a-zA-ZÀ-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+").findall


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"ranks of {path} are not 0 to {len(found) - 1}")
    if (size := sum(map(len, found.values()))) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has {size} bytes of tokens, the limit is {MAX_VOCABULARY_BYTES}")
    return [found[i] for i in range(len(found))]


class MinimalPerfectHash:
    """Maps each of n distinct keys to its own slot of n slots, and any other key to -1."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.size, self.buckets = n, max(1, -(-n // _KEYS_A_BUCKET))
        self.displace = [0] * self.buckets
        self.slot_key: list[bytes] = [b""] * n
        self.slot_value = [-1] * n
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            members[crc32(key) % self.buckets].append(i)
        free = np.ones(n, bool)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        spare: Iterator[int] | None = None
        for b in order:
            own = members[b]
            if not own:
                break
            if len(own) == 1:  # the last buckets hold one key: they name their slot outright
                spare = spare or iter(np.flatnonzero(free).tolist())
                slots = [next(spare)]
                self.displace[b] = -1 - slots[0]
            else:
                for seed in itertools.count(1):
                    slots = [crc32(keys[i], seed) % n for i in own]
                    if len(set(slots)) == len(slots) and free[slots].all():
                        self.displace[b] = seed
                        break
                free[slots] = False
            for i, slot in zip(own, slots, strict=True):
                self.slot_key[slot], self.slot_value[slot] = keys[i], i

    def get(self, key: bytes) -> int:
        seed = self.displace[crc32(key) % self.buckets]
        slot = -1 - seed if seed < 0 else crc32(key, seed) % self.size
        return self.slot_value[slot] if self.slot_key[slot] == key else -1


class BytePairCodec:
    """Encodes pre-tokens to ids and ids to bytes."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.whole = MinimalPerfectHash(tokens)
        self._prepare()

    def _prepare(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.rank = {token: i for i, token in enumerate(self.tokens)}
        key = hashlib.sha256(b"\0".join(self.tokens)).digest()
        self.memo = _MEMOS.setdefault(key, _Memo())
        self.memo.make = self.encode_pretoken

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "pattern": self.pattern, "whole": self.whole}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a byte string that is no entry itself: always merge the pair of lowest rank, leftmost first.

        A part is known by its first byte: ``end`` gives the first byte of the next part, ``left`` that of the one
        before.  A heap entry is stale when its left part is gone or the pair no longer ends where it did.
        """
        rank, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        n = len(piece)
        end, left = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = pop(heap)
            j = end[i]
            if j >= n or end[j] != stop or left[j] != i:
                continue
            end[i], left[j] = stop, -2
            if stop < n:
                left[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    push(heap, (r, i, end[stop]))
            if (k := left[i]) >= 0 and (r := rank(piece[k:stop])) is not None:
                push(heap, (r, k, stop))
        ids, i = [], 0
        while i < n:
            ids.append(self.rank[piece[i : end[i]]])
            i = end[i]
        return ids

    def encode_pretoken(self, text: str) -> bytes:
        piece = text.encode()
        found = self.whole.get(piece)
        return np.array([found] if found >= 0 else self.merge(piece), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        find = _PLAIN if self.pattern == _COMMON and _PLAIN_TEXT(text) else self.find
        return b"".join(map(self.memo.__getitem__, find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memo(dict):
    make = None

    def __missing__(self, key: str) -> bytes:
        made = self[key] = self.make(key)
        return made


#: Memos of this Python process by vocabulary; a reused worker keeps them from task to task.
_MEMOS: dict[bytes, _Memo] = {}


def encode(docs: DataFrame, codec: BytePairCodec, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids binary): the token ids of every text, as little-endian unsigned 32-bit integers."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [codec.encode(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, codec: BytePairCodec) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes that each row's ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def round_trip(docs: DataFrame, codec: BytePairCodec, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): every text encoded and its ids decoded again, in one pass of one Python worker."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [codec.encode(x or "") for x in batch.column("text").to_pylist()]
            decoded = [codec.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def digests(docs: DataFrame, codec: BytePairCodec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again."""
    return round_trip(docs, codec).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
