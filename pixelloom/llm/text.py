"""Vectorised tokenising and shingle hashing over Arrow string buffers.

Words are hashed straight from the UTF-8 bytes of a record batch: a prefix sum of ``value[byte] * BASE**i`` gives
the polynomial hash of every word in a few numpy passes, without a Python object per word.  Polynomials modulo 2**64
agree on long words of a certain build (such as a Thue-Morse word and its complement) for every base, so words of more
than ``SHORT`` bytes are hashed by BLAKE2 instead.  Hashes are 64-bit.
Batches are cut into slices of whole documents of about ``SLICE_BYTES`` so that the temporaries stay small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
SHORT = 24
_U = np.uint64
_BASE = 0x9E3779B97F4A7C17  # odd, 3 mod 4
_WORD_SALT = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _salts(k: int) -> tuple[int, ...]:
    """An odd multiplier for each place of a shingle of k words; those beyond the listed ones are worked out."""
    more = mix64(np.arange(len(_WORD_SALT) + 1, max(k, len(_WORD_SALT)) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    return (*_WORD_SALT, *map(int, more))[:k]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, _U), np.full(n, pow(_BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POW, _INV = _powers(SLICE_BYTES * 2)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, longer tables are made as a document needs them."""
    return (_POW, _INV) if n <= len(_POW) else _powers(n)


def _lower(table: np.ndarray) -> np.ndarray:
    table[65:91] += 32
    return table


#: Byte maps: 0 for a separator, else the byte that is hashed.
SPACES = _lower(np.arange(256, dtype=np.uint8))
SPACES[[0x20, 9, 10, 11, 12, 13]] = 0
ALNUM = _lower(np.arange(256, dtype=np.uint8))
ALNUM[[b for b in range(128) if not chr(b).isalnum()]] = 0
#: A null byte is a word character between spaces.
_NUL_AS = 0xFF


@dataclass
class Words:
    """Words of consecutive documents; document d has words first[d] to first[d + 1]."""

    data: np.ndarray  # bytes of the slice
    doc_start: np.ndarray  # byte offset of each document, and the end
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, byte offsets within the slice, bytes), by whole documents."""
    at, data = text_buffer(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
        yield row, end, at[row : end + 1] - at[row], data[at[row] : at[end]]
        row = end


def words(doc_start: np.ndarray, raw: np.ndarray, table: np.ndarray = SPACES, fold_latin: bool = False, apostrophes: bool = False) -> Words:
    """Words of a slice by a byte map; ``fold_latin`` also lower-cases the two-byte letters U+00C0 to U+00DE.

    With ``apostrophes`` one between two word characters belongs to the word.
    """
    data = table[raw]
    if apostrophes and len(raw) > 2:
        inner = np.flatnonzero((raw[1:-1] == 0x27) & (data[:-2] != 0) & (data[2:] != 0)) + 1
        data[inner[~np.isin(inner, doc_start) & ~np.isin(inner + 1, doc_start)]] = 0x27
    if table is SPACES and (nul := raw == 0).any():
        data = np.where(nul, np.uint8(_NUL_AS), data)
    if fold_latin and len(raw) > 1:
        upper = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        data[1:][upper] += 32
    n = len(data)
    inside = data != 0
    left, right = np.zeros(n, bool), np.zeros(n, bool)
    left[1:], right[:-1] = inside[:-1], inside[1:]
    edges = doc_start[(doc_start > 0) & (doc_start < n)]
    left[edges], right[edges - 1] = False, False
    start, end = np.flatnonzero(inside & ~left), np.flatnonzero(inside & ~right) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE_VALUE[data] * up[:n], out=total[1:])
    h = mix64((total[end] - total[start]) * down[start] + (end - start).astype(_U))
    for i in np.flatnonzero(end - start > SHORT):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return Words(data, doc_start, start, end, h, np.searchsorted(start, doc_start))


def hash_word(word: str, table: np.ndarray = ALNUM, fold_latin: bool = True, apostrophes: bool = True) -> int:
    """The hash that :func:`words` gives a single word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(np.array([0, len(raw)]), raw, table, fold_latin, apostrophes).hash[0])


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the first shingle of each document (n + 1); fewer words count as one shingle."""
    counts = np.diff(w.first)
    n_out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n_out)])
    full = len(w.hash) - k + 1
    rolled = np.zeros(max(full, 0), _U)
    salts = _salts(k)
    for j in range(k):
        rolled += w.hash[j : j + len(rolled)] * _U(salts[j])
    rolled = mix64(rolled + _U(k))
    out = np.zeros(first[-1], _U)
    long_docs = counts >= k
    if long_docs.any():
        begin, many = w.first[:-1][long_docs], n_out[long_docs]
        source = np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        out[np.repeat(long_docs, n_out)] = rolled[source]
    for d in np.flatnonzero((counts > 0) & ~long_docs):
        part = w.hash[w.first[d] : w.first[d + 1]]
        out[first[d]] = mix64(np.array([sum(int(x) * s for x, s in zip(part, salts, strict=False)) + len(part) & (2**64 - 1)], _U))[0]
    return out, first
