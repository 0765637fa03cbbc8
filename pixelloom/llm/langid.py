"""Language identification by word-first backoff.

A known word scores by its log frequency in each language.  A word that was never seen falls back to its longest
known character n-grams: it is covered from the left by n-grams of at most ``NGRAM`` characters, each looked up at the
longest length that is known and else at shorter ones, down to single letters.

A word is a run of letters with their combining marks.  The tables are learned from at most ``TRAIN_ROWS`` labelled
documents, with an equal share for each language (or all it has), so that a rare language is learned too; a repeated
row counts once.  Word counts are aggregated in Spark; n-gram counts derive from them, without the n-grams of more than
one character that the sample holds fewer than ``RARE`` times; both travel with the tasks.  Prediction is map-only.

A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned (an empty
table, no labels).  Ties go to the language that sorts first.  Repeated rows are predicted each, rows with a null
doc_id too; lang, source and doc_id are never inputs of a prediction; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import logistic

TRAIN_ROWS, RARE, NGRAM = 6_000, 3, 5
UNKNOWN = "und"
#: Share of the probability of words that is left to those never seen.
UNSEEN = 0.2
MEMO_ENTRIES, MEMO_BYTES = 300_000, 32 << 20
_ASCII_WORDS, _ALL_WORDS = regex.compile("[a-z]+").findall, regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    low = (text or "").lower()
    return (_ASCII_WORDS if low.isascii() else _ALL_WORDS)(low)


class Model:
    """Log-probabilities of words and n-grams, one row of ``table`` for each."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        size = len(self.languages)
        by_word: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(size))
        grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(size)) for _ in range(NGRAM + 1)]
        for i, lang in enumerate(self.languages):
            for word, n in counts[lang].items():
                by_word[word][i] += n
                for order in range(1, NGRAM + 1):
                    for gram, k in Counter(_grams(word, order)).items():
                        grams[order][gram][i] += n * k
        self.rows: list[np.ndarray] = []
        self.word = self._logs(by_word, 1 - UNSEEN)
        self.gram = {}
        for order in range(1, NGRAM + 1):
            kept = {g: c for g, c in grams[order].items() if order == 1 or c.sum() >= RARE}
            self.gram.update(self._logs(kept, UNSEEN))
        self.table = np.array(self.rows) if self.rows else np.zeros((0, size))
        del self.rows

    def _logs(self, counts: dict[str, np.ndarray], share: float) -> dict[str, int]:
        if not counts:
            return {}
        all_counts = np.array(list(counts.values()))
        smooth = 0.5
        total = all_counts.sum(0) + smooth * len(all_counts)
        first = len(self.rows)
        self.rows.extend(np.log(share * (all_counts + smooth) / total))
        return {key: first + i for i, key in enumerate(counts)}

    def backoff(self, word: str) -> list[int]:
        """Rows of the longest known n-grams that cover an unseen word."""
        marked, at, found = f"^{word}$", 0, []
        while at < len(marked):
            for order in range(min(NGRAM, len(marked) - at), 0, -1):
                if (row := self.gram.get(marked[at : at + order])) is not None:
                    found.append(row)
                    at += max(1, order - 1)  # neighbours overlap by a character
                    break
            else:
                at += 1
        return found

    def predictor(self) -> Predictor:
        return Predictor(self)


def _grams(word: str, order: int) -> Iterator[str]:
    marked = f"^{word}$"
    return (marked[i : i + order] for i in range(len(marked) - order + 1))


class Predictor:
    """Predicts texts; unseen words become rows of its own, growing table until that is full."""

    def __init__(self, model: Model):
        self.model, self.size = model, len(model.languages)
        self.entries = max(1, min(MEMO_ENTRIES, MEMO_BYTES // (8 * max(1, self.size))))
        self._reset()

    def _reset(self) -> None:
        self.row = _Rows(self._add)
        self.row.update(self.model.word)
        self.used = len(self.model.table)
        self.table = np.vstack([self.model.table, np.zeros((self.entries, self.size))])

    def _add(self, word: str) -> int:
        rows = self.model.backoff(word)
        if self.used == len(self.table):
            self.table = np.vstack([self.table, np.zeros((self.entries, self.size))])
        self.table[self.used] = self.model.table[rows].sum(0) if rows else 0
        self.used += 1
        return self.used - 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not found or not self.size:
            return UNKNOWN, 0.0
        total = np.zeros(self.size)
        for i in range(0, len(found), self.entries):
            if self.used > len(self.model.table) + self.entries:
                self._reset()
            rows = list(map(self.row.__getitem__, found[i : i + self.entries]))  # may make a larger table
            total += self.table[rows].sum(0)
        best = int(total.argmax())
        return self.model.languages[best], 1 / float(np.exp(np.maximum(total - total[best], -700)).sum())


class _Rows(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> int:
        made = self[word] = self.make(word)
        return made


def train(docs: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Learn from (doc_id, text, lang) rows with a lang; pass only those that may be learned from."""
    known = docs.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ids = logistic.stratified_ids(known, "lang", limit)
    said = known.withColumn("_text_hash", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "lang", "_text_hash"]).dropDuplicates(["doc_id", "lang", "_text_hash"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts.update((lang, w) for w in words(text))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    counted = said.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for row in sorted(counted.toArrow().to_pylist(), key=lambda r: (r["lang"], r["word"])):
        counts[row["lang"]][row["word"]] = row["n"]
    return Model(counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = model.predictor()
        for batch in batches:
            out = [guess(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
