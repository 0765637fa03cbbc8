"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size (number of distinct k-word shingles, powers of two).  Each size partition has its own
MinHash sketch length: the smallest ``floor((1 - threshold) * largest size) + 1`` shingle hashes of an item.  An item
of which at most ``floor((1 - threshold) * size)`` shingles are missing from a document shares at least one sketch
value with it, so the candidate search loses nothing; every candidate is then verified by exact shingle containment
|item & document| / |item| >= threshold.

The benchmark is the query set and goes against all documents in blocks of bounded size (``BLOCK_SHINGLES``): each
block is one map-only pass over the documents, with no shuffle of the corpus and no limit on the benchmark.

Words are runs of letters, digits and non-ASCII characters, A-Z and the accented Latin-1 letters lower-cased, so that
case and punctuation do not hide an item.  An item or document with fewer than k words is one shingle of its whole
sequence; such an item is also found inside longer documents, by shingles of its own width.  Null or wordless texts
match nothing.  Repeated rows match each; a document without an id is searched and dropped like others, an item without
an id is left out; extra columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import text as T

WORDS = 5
THRESHOLD = 0.8
#: Item shingles that travel with the tasks of one pass, 8 bytes each.
BLOCK_SHINGLES = 2_000_000
_BITS = 20


def item_shingles(items: DataFrame, k: int = WORDS) -> DataFrame:
    """item_id, width (words a shingle), hashes: the sorted distinct shingles of every item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, widths, sets = [], [], []
            for row, end, offsets, raw in T.slices(batch.column("text")):
                w = T.words(offsets, raw, T.ALNUM, fold_latin=True)
                h, first = T.shingles(w, k)
                for d in range(end - row):
                    if first[d] < first[d + 1]:
                        ids.append(row + d)
                        widths.append(min(k, int(w.first[d + 1] - w.first[d])))
                        sets.append(np.unique(h[first[d] : first[d + 1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(ids, pa.int64())), pa.array(widths, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "width", "hashes"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null").mapInArrow(run, f"item_id {kind}, width int, hashes array<long>")


class Block:
    """Items of one pass: their shingles, and the sketches by which they are found."""

    def __init__(self, rows: list, threshold: float):
        self.ids = [r["item_id"] for r in rows]
        self.sets = [np.array(r["hashes"], np.int64).view(np.uint64) for r in rows]
        self.widths = np.array([r["width"] for r in rows])
        self.missing = np.array([int((1 - threshold) * len(s) + 1e-9) for s in self.sets])
        self.need = np.array([len(s) - m for s, m in zip(self.sets, self.missing, strict=True)])
        self.probes = {}  # by width: sorted sketch values, the items of each, and a bit filter before the search
        for width in set(self.widths.tolist()):
            own = np.flatnonzero(self.widths == width)
            size = np.array([len(self.sets[i]) for i in own])
            part = np.ceil(np.log2(size)).astype(int)  # size partitions: (2^(p-1), 2^p]
            sketch = {p: int((1 - threshold) * size[part == p].max() + 1e-9) + 1 for p in set(part.tolist())}
            values = np.concatenate([self.sets[i][: sketch[p]] for i, p in zip(own, part, strict=True)])
            of = np.concatenate([np.full(min(sketch[p], len(self.sets[i])), i) for i, p in zip(own, part, strict=True)])
            order = np.argsort(values, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[values >> np.uint64(64 - _BITS)] = True
            self.probes[width] = (values[order], of[order], bits)

    def search(self, shingles: np.ndarray, doc: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
        """(document, item) candidates: each pair that shares a sketch value, once."""
        values, of, bits = self.probes[width]
        maybe = np.flatnonzero(bits[shingles >> np.uint64(64 - _BITS)])
        low = np.searchsorted(values, shingles[maybe], "left")
        high = np.searchsorted(values, shingles[maybe], "right")
        pairs = {(int(doc[at]), int(i)) for at, a, b in zip(maybe[low < high], low[low < high], high[low < high], strict=True) for i in of[a:b]}
        return iter(sorted(pairs))


def blocks(items: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> Iterator[Block]:
    """The benchmark as blocks of bounded size; a block takes whole items, by a hash of item_id."""
    sets = item_shingles(items, k)
    total = sets.agg(F.sum(F.size("hashes"))).first()[0] or 0
    n = max(1, -(-total // block_shingles))
    for b in range(n):
        if rows := sets.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect():
            yield Block(rows, threshold)


def find_items(docs: DataFrame, items: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_found, n_item, containment: every document that holds the threshold's share of an item."""
    kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for block in blocks(items, k, threshold, block_shingles):
        hits = _pass(docs, block, k, kind)
        found = hits if found is None else found.unionByName(hits)
    return _pass(docs.limit(0), None, k, kind) if found is None else found


def clean(docs: DataFrame, items: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents that hold no item, with all their columns; map-only, one pass for each block."""

    def dropping(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, _, _ in _hits(block, batch.column("text").cast(pa.string()), k):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in blocks(items, k, threshold, block_shingles):
        docs = docs.mapInArrow(dropping(block), docs.schema)
    return docs


def _hits(block: Block, column: pa.Array, k: int) -> Iterator[tuple[int, int, int]]:
    """(row, item, shingles found) of a column of texts."""
    for row, end, offsets, raw in T.slices(column):
        w = T.words(offsets, raw, T.ALNUM, fold_latin=True)
        for width in block.probes:
            yield from ((row + d, i, n) for d, i, n in _verified(block, w, k, width, end - row))


def _pass(docs: DataFrame, block: Block | None, k: int, item_kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(_hits(block, batch.column("text"), k)) if block else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([d for d, _, _ in out], pa.int64())), pa.array([block.ids[i] for _, i, _ in out], _ARROW.get(item_kind, pa.int64())), pa.array([n for _, _, n in out], pa.int64()), pa.array([len(block.sets[i]) for _, i, _ in out], pa.int64())],
                ["doc_id", "item_id", "n_found", "n_item"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, n_found long, n_item long")
    return hits.withColumn("containment", F.col("n_found") / F.col("n_item"))


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _verified(block: Block, w: T.Words, k: int, width: int, n_docs: int) -> Iterator[tuple[int, int, int]]:
    """(document, item, shingles found) of the candidates that pass the exact check."""
    h, first = T.shingles(w, width)
    if width < k:  # a whole short sequence, inside documents that have as many words
        enough = np.repeat(np.diff(w.first) >= width, np.diff(first))
        h = np.where(enough, h, np.uint64(0))
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    for d, i in block.search(h, doc, width):
        item = block.sets[i]
        own = np.unique(h[first[d] : first[d + 1]])
        at = np.searchsorted(own, item)
        n = int((own[np.minimum(at, len(own) - 1)] == item).sum())
        if n >= block.need[i]:
            yield d, i, n

