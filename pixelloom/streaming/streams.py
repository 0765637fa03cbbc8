"""Structured Streaming forms: arriving images, latest settings, debounce, rolling and windowed timings.

Requests that wait, and results of requests, have one rule (:func:`undisturbed`): a row counts if its key has no other
row until its wait has passed.  It has a form for tables and one for streams, with event-time timers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pixelloom.operators import ranges
from pixelloom.operators.metrics import nearest_rank
from pixelloom.sources.images import explode_pixels, image_rows

IMAGE_SCHEMA = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
#: Fields that a slider changes.
SLIDERS = ("width", "height", "scale", "alpha_threshold", "strength", "radius", "threshold", "softness")
SLIDER_WAIT = "180 milliseconds"
HISTORY = 100


def stream_images(spark: SparkSession, path: str, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand the pixels of newly arrived image files to ``process(pixels, batch_id)``."""
    arriving = spark.readStream.schema(IMAGE_SCHEMA).format("image").load(path)
    return arriving.writeStream.foreachBatch(lambda batch, n: process(explode_pixels(image_rows(batch)), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(changes: DataFrame, key: str, value: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The newest value of each key.  On a stream, run it in update or complete mode; the state is one row a key."""
    order = F.struct(*(F.col(c) for c in (ts, tie) if c))
    return changes.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(ts).alias(ts))


def debounce(changes: DataFrame, gap: str, key: str = "key", sliders: Column | None = None) -> DataFrame:
    """key, ts, value, field: slider changes that follow each other within the gap count once, by their last; others each.

    Works on a table, and with a watermark on a stream (append mode).
    """
    slides = F.col("field").isin(*SLIDERS) if sliders is None else sliders
    session = changes.where(slides).groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.max_by(F.struct("ts", "value", "field"), F.struct("ts", "value")).alias("v"))
    return session.select(key, "v.ts", "v.value", "v.field").unionByName(changes.where(~slides).select(key, "ts", "value", "field"))


def slider_wait(wait: str = SLIDER_WAIT, sliders: Column | None = None) -> Column:
    """How long a change waits for the next, in microseconds: the wait if it only moves a slider, else nothing."""
    slides = F.col("field").isin(*SLIDERS) if sliders is None else sliders
    start = F.timestamp_micros(F.lit(0))
    return F.when(slides, F.unix_micros(start + F.expr(f"INTERVAL {wait}")) - F.unix_micros(start)).otherwise(0)


def undisturbed(rows: DataFrame, wait: Column, key: str = "key", tie: str = "value") -> DataFrame:
    """The rows (key, ts, a whole-number tie, others) whose wait in microseconds passes before the key's next row, with ``run_at``.

    A row at the very end of a wait still comes in between; rows of one time are ordered by tie, and of rows that are
    equal in both one stays.  Rows without a time are left out, as are those without a wait; a null key is a key.  A key
    with all rows is spread over tasks.
    """
    timed = rows.withColumns({"_us": F.unix_micros("ts"), "_wait": wait}).where("_us is not null and _wait is not null")
    parts = ranges.ranged(timed.withColumn("_order", F.struct("_us", tie)), [key], "_order")
    due = F.col("_us") + F.col("_wait")
    kept = ranges.with_next(parts, "_order", {"_next": "_us"}).where(F.col("_next").isNull() | (F.col("_next") > due))
    return kept.select(*rows.columns, F.timestamp_micros(due).alias("run_at"))


class Undisturbed(StatefulProcessor):
    """Keeps the rows of a key that no later row has replaced, until the watermark has passed their waits.

    A replaced row leaves the state at once, a row whose wait has passed leaves it by a timer; a key without waiting rows
    has no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, tie long, wait long, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        for frame in rows:
            held += zip(frame["us"].tolist(), frame["tie"].tolist(), frame["wait"].tolist(), frame["row"].tolist(), strict=True)
        held.sort(key=lambda r: r[:2])
        kept = [r for r, after in zip(held, [*held[1:], None], strict=True) if after is None or after[0] > r[0] + r[2]]
        self.waiting.put(kept)
        for us, _, wait, _ in kept:
            self.handle.registerTimer(-(-(us + wait) // 1000))  # a timer that is there already stays one
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due, rest = [r for r in held if r[0] + r[2] <= now], [r for r in held if r[0] + r[2] > now]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if due:
            yield pd.DataFrame({"row": [r[3] for r in due], "us": [r[0] + r[2] for r in due]})

    def close(self) -> None:
        pass


def undisturbed_stream(rows: DataFrame, wait: Column, watermark: str, key: str = "key", tie: str = "value") -> DataFrame:
    """:func:`undisturbed` on a stream, in append mode: a row comes out when the watermark has passed its wait.

    Rows later than the watermark are dropped; others may come in any order.  Needs the RocksDB state store.
    """
    packed = F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    timed = rows.withWatermark("ts", watermark).select("ts", F.col(key).alias("key"), F.unix_micros("ts").alias("us"), F.col(tie).cast("long").alias("tie"), wait.cast("long").alias("wait"), packed.alias("row"))
    timed = timed.where("us is not null and wait is not null").withColumn("tie", F.coalesce("tie", F.lit(-(1 << 63))))
    out = timed.groupBy("key").transformWithStateInPandas(Undisturbed(), "row string, us long", "Append", "EventTime")
    return out.select(F.from_json("row", rows.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("r"), F.timestamp_micros("us").alias("run_at")).select("r.*", "run_at")


def windowed_timings(samples: DataFrame, window: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """name, start and count, average, maximum of timings (ts, name, ms) by tumbling or sliding window."""
    timed = samples.withWatermark("ts", watermark) if watermark else samples
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return timed.groupBy("name", w.alias("w")).agg(F.count("*").alias("n"), F.avg("ms").alias("average"), F.max("ms").alias("max"), F.percentile_approx("ms", 0.95).alias("p95")).select("name", F.col("w.start").alias("start"), "n", "average", "max", "p95")


def exactly_once(arriving: DataFrame, done: DataFrame, key: str = "settings_hash") -> DataFrame:
    """Rows whose identity has no output yet, each identity once; for the batches of ``foreachBatch``.

    One aggregation by identity over both sides, so that each is moved once and nothing is sorted for a join.  A null is
    no identity of an output.
    """
    both = arriving.withColumn("_done", F.lit(False)).unionByName(done.where(F.col(key).isNotNull()).select(key, F.lit(True).alias("_done")), True)
    held = both.groupBy(key).agg(F.max("_done").alias("_done"), *(F.first(c).alias(c) for c in arriving.columns if c != key))
    return held.where(~F.col("_done")).drop("_done")


def exactly_once_stream(arriving: DataFrame, ts: str, watermark: str, key: str = "settings_hash") -> DataFrame:
    return arriving.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


class RollingHistory(StatefulProcessor):
    """Keeps the last HISTORY totals of a key's current scope and returns their summary after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scope = handle.getValueState("scope", "scope string")
        self.totals = handle.getListState("totals", "seq long, ms double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows)).sort_values("seq")
        scope = self.scope.get()[0] if self.scope.exists() else None
        kept = [tuple(x) for x in self.totals.get()] if self.totals.exists() else []
        for row in frame.itertuples(index=False):
            if row.scope_key != scope:
                scope, kept = row.scope_key, []
            kept = [*kept, (int(row.seq), float(row.ms))][-HISTORY:]
        self.scope.update((scope,))
        self.totals.put(kept)
        ms = sorted(x for _, x in kept)
        rank = lambda p: ms[max(0, -(-len(ms) * p // 100) - 1)]
        yield pd.DataFrame({"key": [key[0]], "scope_key": [scope], "n": [len(ms)], "average": [sum(ms) / len(ms)], "p95": [rank(95)]})

    def close(self) -> None:
        pass


ROLLING_SCHEMA = "key string, scope_key string, n long, average double, p95 double"


def rolling_timings(samples: DataFrame) -> DataFrame:
    """Live summary of (key, seq, scope_key, ms) by key: the current scope's last HISTORY rows.  Needs the RocksDB state store."""
    return samples.groupBy("key").transformWithStateInPandas(RollingHistory(), ROLLING_SCHEMA, "Update", "None")


def rolling_timings_batch(samples: DataFrame) -> DataFrame:
    """The same over a table."""
    from pixelloom.operators.metrics import scoped_history

    kept = scoped_history(samples, ["key"], HISTORY)
    return kept.groupBy("key").agg(F.max("scope_key").alias("scope_key"), F.count("*").alias("n"), F.avg("ms").alias("average"), nearest_rank("ms", 0.95).alias("p95"))


def change_gaps(changes: DataFrame, key: str = "key") -> DataFrame:
    """Adds ``gap_s``, the seconds since the key's change before."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "value"))
    return changes.withColumn("gap_s", F.unix_micros("ts") / 1e6 - F.unix_micros(before) / 1e6)
