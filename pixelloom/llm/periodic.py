"""Periodic runs of words inside documents: seed and extend along diagonals, exact.

A run is a maximal stretch of words with smallest period q (words q apart are identical) of at least ``max(least, 2 q)``
words.  On the diagonal of lag q such a run is a stretch of at least ``max(least - q, q)`` matches.

1. Lags are divided into levels.  A level's seeds are word grams of length g: 3 for lags below 12, and then twice as long
   for each doubling of the lag, [2 g, 4 g).  That is half of the overlap which a run of such a lag guarantees, so
   every stretch covers a whole gram that begins at a multiple of g.
2. The index of a level holds the grams that occur again in their document, as exact ranks (pairs of ranks of the level
   before, so no hashes).  Only grams at multiples of g are looked up, at the level's lags: a document of n words has at
   most 4 n occurrence pairs a level however often a word repeats, and as many levels as the logarithm of n.
3. Pairs inside a run that is known already, at a multiple of its period that is no longer than a gram, belong to no
   other run (a stretch of q + p words with periods p and q = m p passes p on to the whole run), and go.  A pair that
   follows another of its diagonal by one gram continues the same stretch, and goes.  What is left is extended; for each
   lag the furthest word covered suppresses repeated extensions.
4. A stretch of the needed length is a run unless a proper divisor of q is a period too.

Documents of a slice are worked on together; a word has a number of its own in each document, so nothing matches across
them.  A document is the work of one task, in memory that grows with its words, not with its pairs.

Null or wordless texts have no runs and an empty collapsed text.  Rows with a null doc_id and repeated rows each come
back.  Extra columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import text as T

LEAST = 12
_RUNS = "array<struct<start:long,length:long,period:long>>"


def _equal(codes: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j on, forwards (step 1) or backwards from before them (-1), are equal; i < j."""
    limit, n, width = (len(codes) - j) if step > 0 else i, 0, 16
    while n < limit:
        m = min(width, limit - n)
        if step > 0:
            differ = codes[i + n : i + n + m] != codes[j + n : j + n + m]
        else:
            differ = codes[i - n - m : i - n][::-1] != codes[j - n - m : j - n][::-1]
        if differ.any():
            return n + int(differ.argmax())
        n, width = n + m, width * 4
    return n


def _has_smaller_period(codes: np.ndarray, start: int, end: int, q: int) -> bool:
    rest, f = q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            d = q // f
            if np.array_equal(codes[start : end - d], codes[start + d : end]):
                return True
            while rest % f == 0:
                rest //= f
        f += 1
    return False


def _repeated(key: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the keys that occur more than once, by position; -1 elsewhere."""
    _, rank, many = np.unique(key, return_inverse=True, return_counts=True)
    out = np.full(size, -1, np.int64)
    own = many[rank] > 1
    out[at[own]] = rank[own]
    return out


def _longer(grams: np.ndarray, by: int, other: np.ndarray) -> np.ndarray:
    """Ranks of the repeated grams that are a gram and the other gram ``by`` words further on."""
    at = np.flatnonzero((grams[: len(grams) - by] >= 0) & (other[by:] >= 0)) if by < len(grams) else np.zeros(0, np.int64)
    return _repeated(grams[at] * len(grams) + other[at + by], at, len(grams))


def _pairs(grams: np.ndarray, g: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of the grams at multiples of g that occur again at a lag in [low, high)."""
    size = len(grams) + high
    at = np.flatnonzero(grams >= 0)
    index = np.sort(grams[at] * size + at)
    seed = at[at % g == 0]
    first = np.searchsorted(index, grams[seed] * size + seed + low)
    many = np.searchsorted(index, grams[seed] * size + seed + high) - first
    place = np.repeat(seed, many)
    found = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    return place, index[found] % size - place


def find_runs(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by start and period; codes differ between documents and between words."""
    runs: list[tuple[int, int, int]] = []
    words = _repeated(codes, np.arange(len(codes)), len(codes))
    grams, g = _longer(_longer(words, 1, words), 2, words), 3
    furthest: dict[int, int] = {}
    while (grams >= 0).any():
        place, lag = _pairs(grams, g, 1 if g == 3 else 2 * g, 4 * g)
        for some in [lag == q for q in range(1, 4 * g)] if g == 3 else [slice(None)]:  # a short lag may be a multiple of another
            i, q = place[some], lag[some]
            keep = np.ones(len(i), bool)
            for start, end, p in runs:
                if p <= g and len(i) and end - start >= p + g:
                    own = slice(*np.searchsorted(i, (start, end)))
                    keep[own] &= (q[own] % p != 0) | (i[own] + q[own] + g > end)
            i, q = i[keep], q[keep]
            order = np.lexsort((i, q))
            i, q = i[order], q[order]
            new = np.ones(len(i), bool)
            new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1] + g)
            for a, lag_a in zip(i[new].tolist(), q[new].tolist(), strict=True):
                if a < furthest.get(lag_a, 0):
                    continue
                start = a - _equal(codes, a, a + lag_a, -1)
                furthest[lag_a] = matched = a + _equal(codes, a, a + lag_a, 1)
                if matched - start >= max(least - lag_a, lag_a) and not _has_smaller_period(codes, start, matched + lag_a, lag_a):
                    runs.append((start, matched + lag_a, lag_a))
        grams, g = _longer(grams, g, grams), 2 * g
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _document_runs(words: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document."""
    counts = np.array([len(w) for w in words])
    first = np.concatenate([[0], np.cumsum(counts)])
    of = np.repeat(np.arange(len(words)), counts)
    numbers = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for start, end, period in find_runs(numbers * len(words) + of, least):
        out[of[start]].append((int(start - first[of[start]]), end - start, period))
    return out


def _without(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def detect(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length and period, by start and period; words are numbered from 0), collapsed (the text without repeats)."""
    if least < LEAST:
        raise ValueError(f"seeds of three words find runs of {LEAST} words or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, at, raw in T.slices(batch.column("text")):
                data = raw.tobytes()
                words = [data[at[d] : at[d + 1]].split() for d in range(end - row)]
                runs = _document_runs(words, least)
                found = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs]
                left = [b" ".join(_without(w, own)).decode() for w, own in zip(words, runs, strict=True)]
                kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(found, kind), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {doc_id}, runs {_RUNS}, collapsed string")
