"""Spelling variants: words one edit apart, by dense prefix-suffix tiling, exact.

Two different words of lengths c and c or c + 1 are one inserted, deleted or replaced code point apart if the lengths of
their common prefix and common suffix sum to at least the longer length minus one.

1. Words are counted over all documents, in blocks before the shuffle.
2. For any t at most c such a pair has a common prefix of t code points or a common suffix of c - t.  With t = c / 2 a
   word is in four groups: with words of its own length and with those one longer, by prefix and by suffix.
3. A group of more than ``GROUP`` words is divided by the same argument about the code points that its words are not
   known to share, again and again: in the end a single one is free in the shorter words, so that a group is bounded by
   the alphabet.  No group is cut, and hot prefixes cost a few more rounds.
4. The words of a group are padded matrices of code points, aligned left and right; tiles of rows are compared with
   tiles of rows.  A pair is taken in one group only: in the prefix branch wherever its common prefix allows.
5. Groups return a row a word (near words, and the best of them), which are summed by word.
6. Forms are followed to their roots by pointer jumping; a form is at least ``RATIO`` times as common as its word, so
   there are no cycles and a logarithm of rounds.

Null texts have no words.  With a null doc_id no run loses a code point.  Repeated rows count each.  Extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import text as T
from pixelloom.llm.storage import drop, save

LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a group that is compared as it is; different words (and bytes of them) that a task counts before it emits them; compared code points of a tile.
GROUP, BLOCK_WORDS, BLOCK_BYTES, TILE = 512, 200_000, 16 << 20, 1 << 20
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_KEYS = ["c", "p", "s", "below", "key"]


def _counted(doc_ids: list, column: pa.Array, letters: int, delete_every: int) -> Iterator[Counter]:
    """The words of every document, counted."""
    for row, end, at, raw in T.slices(column):
        lowered = raw.tobytes().lower()  # bytes.lower changes A-Z only
        for d in range(row, end):
            runs = Counter(x for x in _RUN.findall(lowered[at[d - row] : at[d - row + 1]].decode()) if len(x) >= letters)
            if not delete_every or doc_ids[d] is None:
                yield runs
                continue
            before, out = zlib.crc32(f"{doc_ids[d]}:".encode()), Counter()
            for run, n in runs.items():
                h = zlib.crc32(run.encode(), before)
                if h % delete_every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) < letters:
                        continue
                out[run] += n
            yield out


def vocabulary(docs: DataFrame, letters: int = LETTERS, least: int = LEAST_COUNT, delete_every: int = 0) -> DataFrame:
    """word, n: letter runs of at least ``letters`` code points that occur at least ``least`` times, A-Z lower-cased.

    With ``delete_every`` a run of a document loses a code point where that number divides the crc32 of ``doc_id:run``.
    """

    def emit(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counter(), 0
        for batch in batches:
            for words in _counted(batch.column("doc_id").to_pylist(), batch.column("text"), letters, delete_every):
                size += sum(len(w) for w in words if w not in held)
                held.update(words)
                if len(held) >= BLOCK_WORDS or size >= BLOCK_BYTES:
                    yield emit(held)
                    held, size = Counter(), 0
        if held:
            yield emit(held)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _branches(rows: DataFrame, first: bool) -> DataFrame:
    """The two groups of every row: by t more code points of its prefix, or by the suffix that is then shared."""
    t = F.expr("p + cast((c - p - s) div 2 as int)")
    below = t if first else F.least("below", t)
    any_t = F.lit(2**31 - 1) if first else F.col("below")
    both = rows.select("word", "n", "c", F.explode(F.array(F.struct(t.alias("p"), F.col("s"), any_t.alias("below")), F.struct(F.col("p"), (F.col("c") - t).alias("s"), below.alias("below")))).alias("to")).select("word", "n", "c", "to.*")
    suffix = F.when(F.col("s") > 0, F.expr("right(word, s)")).otherwise("")
    return both.withColumn("key", F.xxhash64(F.expr("left(word, p)"), suffix))


def _near(groups: DataFrame) -> DataFrame:
    """word, near, best (n and word of the best near word; n negated) of groups (c, p, s, below, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, below, words in zip(batch.column("c").to_pylist(), batch.column("below").to_pylist(), batch.column("words"), strict=True):
                words = sorted(words.as_py(), key=lambda x: (-x["n"], x["word"]))  # the best first
                near, best = compare([x["word"] for x in words], c, below)
                own = np.flatnonzero(near)
                out = [[words[i]["word"] for i in own], near[own], [-words[best[i]]["n"] for i in own], [words[best[i]]["word"] for i in own]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "best_n", "best_word"])

    return groups.select("c", "below", "words").mapInArrow(run, "word string, near long, best_n long, best_word string")


def compare(words: list[str], c: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every word of lengths c and c + 1: the number of its near words and the place of the first of them.

    Only pairs with a word of length c, and with a common prefix shorter than ``below``, are taken.
    """
    size = np.array([len(w) for w in words])
    left = np.array(words, f"<U{c + 1}").view(np.uint32).reshape(len(words), c + 1)  # padded with 0 on the right
    right = np.array([w[::-1] for w in words], f"<U{c + 1}").view(np.uint32).reshape(len(words), c + 1)
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    short = np.flatnonzero(size == c)
    height = max(1, min(len(short), 64))
    width = max(1, TILE // (height * (c + 1)))
    for top in range(0, len(short), height):
        rows = short[top : top + height]
        for side in range(0, len(words), width):
            columns = np.arange(side, min(side + width, len(words)))
            i, j = np.nonzero((size[columns] > c) | (rows[:, None] < columns))
            i, j = rows[i], columns[j]
            prefix = (left[i] != left[j]).argmax(1)  # different words differ somewhere, at the padding at the latest
            suffix = (right[i] != right[j]).argmax(1)
            found = (prefix + suffix >= size[j] - 1) & (prefix < below)
            for a, b in ((i[found], j[found]), (j[found], i[found])):
                near += np.bincount(a, minlength=len(words))
                np.minimum.at(best, a, b)
    return near, best


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n: the number of near words and the most frequent of them (ties: smallest word), of words (word, n) that have any."""
    length = F.char_length("word")
    every = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("c"), F.lit(0).alias("p"), F.lit(0).alias("s"))
    rows, found, used = _branches(every, True), None, []
    while True:
        counts = save(rows.groupBy(*_KEYS).agg(F.count("*").alias("many")).where("many > 1"), "spelling-groups")
        members = save(rows.join(counts, _KEYS), "spelling-members")
        hot = F.expr(f"many > {GROUP} and c - p - s > 1")
        packed = members.where(~hot).groupBy(*_KEYS).agg(F.collect_list(F.struct("word", "n")).alias("words"))
        near = save(_near(packed), "spelling-near")
        found = near if found is None else found.unionByName(near)
        used += [counts, members, near]
        if counts.where(hot).isEmpty():
            break
        rows = _branches(members.where(hot), False)
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("best_n", "best_word")).alias("best"))
    out = save(best.select("word", "n_near", F.col("best.best_word").alias("form"), (-F.col("best.best_n")).alias("form_n")), "spelling")
    drop(*used)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): forms are followed to the last."""
    now = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = save(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not after.where("moved").isEmpty()
        drop(now)
        now = after
        if not moved:
            return now.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n), which are distinct.

    A word's form is its near word of largest n if that is at least ``ratio`` times its own; its root is where forms end.
    """
    words = save(words.select("word", "n"), "vocabulary")
    joined = words.join(near_words(words), "word", "left")
    good = F.col("form_n") >= ratio * F.col("n")
    joined = save(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "forms")
    drop(words)
    last = roots(joined.where("form is not null"))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
