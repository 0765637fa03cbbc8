"""Quality classifier by co-training on two views of a document.

The content view sees the text only: shares of capitals, symbols, digits, repeated words and the like.  The metadata
view sees source, lang, n_chars.  Each view is a logistic model on quantile bins of its features.  In every round the
views label all unlabelled documents for each other, but only where their calibrated probability is extreme and
where, on the held-back labelled fold, labels of that confidence are right often enough; rounds admit ever less extreme
ones.  What a view is told is counted by feature, bin and label; the evidence of these counts is the centre of the
prior of its next fit on the labelled rows.  At the end both views are calibrated on the held-back fold and combined by
a logistic model of their log-odds, which scores all documents.

The models are fitted on the driver from at most ``TRAIN_ROWS`` labelled rows (of features, not texts) and from the
counts, whose number depends on the bins alone.  The bins of all unlabelled documents are a saved table, read once a
round; scoring is map-only.  Null or empty texts have zero content features and are scored by them; null metadata is a
value of its own.  Repeated rows are scored each and, unlabelled, counted each, rows with a null doc_id too; of a
labelled doc_id with several rows, the smallest (by text, then metadata) is learned from.  Other columns, whatever their
names, pass through unchanged.  Without any labels every score is that of the priors; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import logistic
from pixelloom.llm import text as T
from pixelloom.llm.storage import drop, save

TRAIN_ROWS = 20_000
#: Probability, by round, from which a view labels documents for the other, and how often it must be right on the fold.
CONFIDENT, PRECISION = (0.995, 0.99, 0.98, 0.97), 0.95
#: Documents of either label, in their overall proportion, that are added to the counts of every bin.
SMOOTH = 4.0
#: Log-odds beyond this are taken for it.
LIMIT = 13.8
#: A category's value with so many rows in the sample has an indicator of its own; all others share indicators by a hash.
OFTEN, BUCKETS = 20, 32
#: Quantiles at which a feature is cut into bins.
CUTS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)
TEXT_FEATURES = ("capitals", "symbols", "pipes", "exclamations", "digits", "line breaks", "non-ASCII", "word length", "words", "distinct words", "commonest word", "distinct word triples", "words of symbols")
_CLASSES = np.zeros((256, 8), np.int64)
_CLASSES[65:91, 0] = 1
_CLASSES[97:123, 1] = 1
_CLASSES[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"!?-()|"], 2] = 1
_CLASSES[ord("|"), 3] = 1
_CLASSES[ord("!"), 4] = 1
_CLASSES[48:58, 5] = 1
_CLASSES[10, 6] = 1
_CLASSES[128:, 7] = 1


def text_features(column: pa.Array) -> np.ndarray:
    """A row of TEXT_FEATURES for each text."""
    out = np.zeros((len(column), len(TEXT_FEATURES)))
    for row, end, offsets, raw in T.slices(column):
        n = end - row
        size = np.maximum(np.diff(offsets), 1)
        sums = np.zeros((n, 8))
        for c in range(8):
            total = np.concatenate([[0], np.cumsum(_CLASSES[raw, c])])
            sums[:, c] = total[offsets[1:]] - total[offsets[:-1]]
        w = T.words(offsets, raw)
        count = np.diff(w.first)
        many = np.maximum(count, 1)
        doc = np.repeat(np.arange(n), count)
        bare = np.concatenate([[0], np.cumsum(T.ALNUM[raw] != 0)])
        empty = np.bincount(doc, bare[w.end] == bare[w.start], n)
        lengths = np.bincount(doc, (w.end - w.start).astype(float), n)
        distinct, commonest = _repeats(doc, w.hash, n)
        triples, first = T.shingles(w, 3)
        distinct3, _ = _repeats(np.repeat(np.arange(n), np.diff(first)), triples, n)
        letters = np.maximum(sums[:, 0] + sums[:, 1], 1)
        out[row:end] = np.column_stack([
            sums[:, 0] / letters, sums[:, 2] / size, sums[:, 3] / size, sums[:, 4] / size, sums[:, 5] / size, sums[:, 6] / size, sums[:, 7] / size,
            lengths / many, np.log1p(count), distinct / np.sqrt(many), commonest / many, distinct3 / np.maximum(np.diff(first), 1), empty / many,
        ])
    return out


def _repeats(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By document: distinct hashes, and how often the commonest occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    of = (key[new] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.append(new, len(key))).astype(float))
    return np.bincount(of, minlength=n).astype(float), most


@dataclass
class View:
    """A logistic model on bins: those of a view's numbers are ordered and have a weight for each step, those of its categories have one each."""

    cuts: list[np.ndarray]
    values: list[list[str]]
    weights: np.ndarray | None = None
    scale: np.ndarray | None = None  # Platt: slope and intercept on the log-odds

    @classmethod
    def of(cls, numbers: np.ndarray, categories: list[list]) -> View:
        cuts = [np.unique(np.quantile(numbers[:, j], CUTS)) if len(numbers) else np.zeros(0) for j in range(numbers.shape[1])]
        values = []
        for column in categories:
            seen, count = np.unique(np.array([str(x) for x in column], object), return_counts=True)
            values.append(seen[count >= OFTEN].tolist())
        return cls(cuts, values)

    @property
    def widths(self) -> list[int]:
        """The number of bins of every feature."""
        return [len(c) + 1 for c in self.cuts] + [len(v) + BUCKETS for v in self.values]

    def bins(self, numbers: np.ndarray, categories: list[list]) -> np.ndarray:
        """A row of bins for each document, one for every feature."""
        columns = [np.searchsorted(c, numbers[:, j], "right") for j, c in enumerate(self.cuts)]
        for column, known in zip(categories, self.values, strict=True):
            at = {v: i for i, v in enumerate(known)}
            columns.append([at[x] if x in at else len(known) + zlib.crc32(x.encode()) % BUCKETS for x in map(str, column)])
        return np.column_stack(columns).astype(np.int32)

    def encode(self, bins: np.ndarray) -> np.ndarray:
        """Indicators of the steps reached by every number, then of the bin of every category."""
        steps = [bins[:, j, None] > np.arange(len(c)) for j, c in enumerate(self.cuts)]
        hot = [bins[:, j, None] == np.arange(w) for j, w in enumerate(self.widths) if j >= len(self.cuts)]
        return np.hstack(steps + hot).astype(float)

    def counts(self, bins: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows by cell (the bins of all features, one feature after the other) and label."""
        cells = bins + np.concatenate([[0], np.cumsum(self.widths)[:-1]]).astype(np.int64)
        return np.column_stack([np.bincount(cells[y == label].ravel(), minlength=sum(self.widths)) for label in (0, 1)])

    def fit(self, bins: np.ndarray, y: np.ndarray, told: np.ndarray, l2: float = 1.0) -> None:
        """Fit on labelled rows; the prior is centred on the evidence of the counts that the view was told.

        The told documents of a label weigh at most as much as its labelled rows together, so a large and one-sided pool does
        not outweigh them.  Evidence of features that go together is counted more than once, so a slope fitted on the rows
        scales it.
        """
        own, first = self.counts(bins, y), slice(0, self.widths[0])
        count = told * np.minimum(1.0, own[first].sum(0) / np.maximum(told[first].sum(0), 1))
        total = count[first].sum(0) + 1.0
        expected = SMOOTH * total / total.sum()
        evidence = np.log(count[:, 1] + expected[1]) - np.log(count[:, 0] + expected[0]) - np.log(total[1] / total[0])
        by_feature = np.split(evidence, np.cumsum(self.widths)[:-1])
        numbers, categories = by_feature[: len(self.cuts)], by_feature[len(self.cuts) :]
        x = self.encode(bins)
        steps = np.concatenate([*(np.diff(e) for e in numbers), *categories, [sum(e[0] for e in numbers)]])
        slope, start = logistic.fit((x @ steps[:-1] + steps[-1])[:, None], y)
        prior = max(slope, 0.0) * steps
        prior[-1] += start
        self.weights = logistic.fit(x, y, prior, l2=l2)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        """Log-odds before calibration, a lookup for every feature."""
        out, at = np.full(len(bins), self.weights[-1]), 0
        for j, width in enumerate(self.widths):
            own = width - 1 if j < len(self.cuts) else width
            w = self.weights[at : at + own]
            out += (np.concatenate([[0.0], np.cumsum(w)]) if j < len(self.cuts) else w)[bins[:, j]]
            at += own
        return np.clip(out, -LIMIT, LIMIT)

    def calibrate(self, bins: np.ndarray, y: np.ndarray) -> None:
        self.scale = logistic.fit(self.raw(bins)[:, None], y, np.array([1.0, 0.0]), l2=10.0)

    def log_odds(self, bins: np.ndarray) -> np.ndarray:
        return self.scale[0] * self.raw(bins) + self.scale[1]


@dataclass
class Model:
    content: View
    metadata: View
    mix: np.ndarray

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        """The probability of good quality."""
        numbers, words, facts = features(batch)
        a = self.content.log_odds(self.content.bins(numbers, []))
        b = self.metadata.log_odds(self.metadata.bins(words, facts))
        return logistic.predict(np.column_stack([a, b]), self.mix)


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[list]]:
    """Numbers of the content view, numbers of the metadata view, categories of the metadata view."""
    chars = batch.column("n_chars").cast(pa.float64())
    known = np.nan_to_num(chars.fill_null(-1).to_numpy(zero_copy_only=False), nan=-1.0)
    facts = [batch.column("source").to_pylist(), batch.column("lang").to_pylist(), (known < 0).tolist()]
    return text_features(batch.column("text")), np.log1p(np.maximum(known, 0))[:, None], facts


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("double").alias("n_chars"))


def _sampled(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray, list[list], np.ndarray]:
    """Features and labels of a bounded sample (doc_id, y); rows in an order that does not depend on partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, words, facts = features(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(list(numbers), pa.list_(pa.float64())), pa.array(words[:, 0]), *(pa.array([str(x) for x in f]) for f in facts)],
                ["doc_id", "y", "content", "chars", "source", "lang", "unknown"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ("text", "source", "lang", "n_chars")
    one = _columns(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*fields)).alias("x"))  # one row for a doc_id
    joined = one.select("doc_id", *(F.col("x")[c].alias(c) for c in fields), "y")
    got = joined.mapInArrow(run, f"doc_id {kind}, y double, content array<double>, chars double, source string, lang string, unknown string").toPandas().sort_values(["doc_id", "y"], kind="stable")
    numbers = np.array(got["content"].tolist(), float).reshape(-1, len(TEXT_FEATURES))
    return numbers, got[["chars"]].to_numpy(), [got[c].tolist() for c in ("source", "lang", "unknown")], got["y"].to_numpy()


def _binned(docs: DataFrame, known: DataFrame, views: list[View]) -> DataFrame:
    """The bins of both views (columns content, metadata) of all documents without a label, repeated rows and null doc_ids included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, chars, facts = features(batch)
            parts = [views[0].bins(numbers, []), views[1].bins(chars, facts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(p), pa.list_(pa.int32())) for p in parts)], ["doc_id", "content", "metadata"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    binned = _columns(docs).mapInArrow(run, f"doc_id {kind}, content array<int>, metadata array<int>")
    return binned.join(known.select("doc_id"), "doc_id", "left_anti").select("content", "metadata")


def exchange(pool: DataFrame, views: list[View], bounds: list[tuple[float, float]]) -> list[np.ndarray]:
    """What each view is told by the other: counts of the pool's rows by cell and label.

    ``bounds`` has, for every view, the log-odds up to which it says 0 and those from which it says 1.
    """
    sizes = [sum(v.widths) for v in views]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [np.zeros((n, 2), np.int64) for n in sizes]
        for batch in batches:
            bins = [batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("content", "metadata")]
            for v, view in enumerate(views):
                odds, (low, high) = view.log_odds(bins[v]), bounds[v]
                said = np.where(odds >= high, 1, np.where(odds <= low, 0, -1))
                told[1 - v] += views[1 - v].counts(bins[1 - v], said)
        flat = np.concatenate([t.ravel() for t in told])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["cell", "n"])

    total = np.zeros(2 * sum(sizes))
    for cell, n in pool.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        total[cell] = n
    return [t.reshape(-1, 2) for t in np.split(total, [2 * sizes[0]])]


def _bounds(view: View, bins: np.ndarray, y: np.ndarray, confident: float) -> tuple[float, float]:
    """Log-odds from which the view's labels count; infinite where they are not right often enough on the fold, or never so sure."""
    odds, edge = view.log_odds(bins), float(logistic.logit(np.float64(confident)))
    trusted = lambda sure, label: sure.any() and (y[sure] == label).mean() >= PRECISION
    return (-edge if trusted(odds <= -edge, 0) else -np.inf), (edge if trusted(odds >= edge, 1) else np.inf)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, confident: tuple[float, ...] = CONFIDENT) -> Model:
    known = labels.where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    numbers, chars, facts, y = _sampled(docs, logistic.sample_ids(known, train_rows))
    views = [View.of(numbers, []), View.of(chars, facts)]
    bins = [views[0].bins(numbers, []), views[1].bins(chars, facts)]
    pool = save(_binned(docs, known, views), "quality-pool") if len(y) else None
    held = np.arange(len(y)) % 3 == 0  # the fold for calibration
    told = [np.zeros((sum(v.widths), 2)) for v in views]
    for sure in (*confident, None):
        for v, view in enumerate(views):
            view.fit(bins[v][~held], y[~held], told[v])
            view.calibrate(bins[v][held], y[held])
        if sure is not None and pool is not None:
            bounds = [_bounds(view, b[held], y[held], sure) for view, b in zip(views, bins, strict=True)]
            if np.isfinite(bounds).any():
                told = exchange(pool, views, bounds)
    if pool is not None:
        drop(pool)
    logits = np.column_stack([v.log_odds(b[held]) for v, b in zip(views, bins, strict=True)])
    return Model(*views, logistic.fit(logits, y[held], np.array([1.0, 0.0, 0.0]), l2=10.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of good quality, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch))], ["doc_id", "score"])

    return _columns(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def reject_poor(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""

    casts = {"text": pa.string(), "source": pa.string(), "lang": pa.string(), "n_chars": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = pa.RecordBatch.from_arrays([batch.column(c).cast(kind) for c, kind in casts.items()], list(casts))
            yield batch.filter(pa.array(model.score(read) >= threshold))

    return docs.mapInArrow(run, docs.schema)
