"""Run statistics, timing summaries, histories and comparisons of results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.operators import bands, ranges
from pixelloom.saved import save


def nearest_rank(column: str, share: float) -> Column:
    """The smallest value with at least the share of all values at or below it.

    Keeps the distinct values of a group in one buffer, so it is for small groups; for others see :func:`nearest_ranks`.
    """
    return F.expr(f"percentile_disc({share}) within group (order by {column})")


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """_k (a struct of the keys, so that null keys join) and the nearest rank of each share by its name; nulls do not count.

    Equal values are counted before they are shuffled, then summed by range of values (64 for a doubling).  Only ranges
    that hold a wanted rank are sorted, each by itself, so that a group of most rows is not the work of one task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    place = F.when(F.isnan("v"), F.lit(2**63 - 1)).otherwise(F.signum("v").cast("long") * F.floor(F.log2(F.abs("v") + 1) * 64))
    counted = counted.withColumn("place", place)
    group = Window.partitionBy("_k")
    sums = counted.groupBy("_k", "place").agg(F.sum("n").alias("n"))
    sums = sums.select("_k", "place", (F.sum("n").over(group.orderBy("place")) - F.col("n")).alias("before"), "n", F.sum("n").over(group).alias("total"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), (F.col("total") * share).alias("rank")) for name, share in shares.items()))
    wanted = sums.select("_k", "place", "before", "n", F.explode(wanted).alias("w")).where("before < w.rank and w.rank <= before + n").select("_k", "place", "w.name", (F.col("w.rank") - F.col("before")).alias("rank"))
    asked = counted.join(wanted.select("_k", "place").distinct(), ["_k", "place"])
    summed = asked.select("_k", "place", "v", F.sum("n").over(Window.partitionBy("_k", "place").orderBy("v")).alias("upto"))
    return summed.join(wanted, ["_k", "place"]).where("upto >= rank").groupBy("_k").agg(*(F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))


def run_stats(runs: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """Count, min, mean, median, p95, max, population deviation, CV (0 for a mean of 0) and outliers of each group.

    Outliers lie beyond 1.5 interquartile ranges of the nearest-rank quartiles; there are none if that range is 0.
    """
    rows = runs.withColumn("_k", F.struct(*keys))
    ranks = nearest_ranks(runs, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95})
    base = rows.groupBy("_k").agg(F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_pop(value).alias("stddev"))
    fence = (F.col("q3") - F.col("q1")) * 1.5
    beyond = (F.col("q3") > F.col("q1")) & ((F.col(value) < F.col("q1") - fence) | (F.col(value) > F.col("q3") + fence))
    outliers = rows.select("_k", value).join(ranks.select("_k", "q1", "q3"), "_k").groupBy("_k").agg(F.count_if(beyond).alias("outliers"))
    cv = F.when(F.col("mean") == 0, 0.0).otherwise(F.col("stddev") / F.col("mean"))
    every = base.join(ranks, "_k", "left").join(outliers, "_k", "left")
    return every.select("_k.*", "n", "min", "mean", "median", "p95", "max", "stddev", cv.alias("cv"), F.coalesce("outliers", F.lit(0)).alias("outliers"))


def timing_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Per name: count, latest, average, p95, p98, p99 of (keys, seq, total_ms, timings array<struct<name, ms>>).

    The totals are a timing named ``total``; negative times count as 0, non-finite ones are left out.
    """
    parts = samples.select(*keys, "seq", F.explode("timings").alias("t")).select(*keys, "seq", "t.name", "t.ms")
    every = parts.unionByName(samples.select(*keys, "seq", F.lit("total").alias("name"), F.col("total_ms").alias("ms")))
    finite = every.where(~F.isnan("ms") & (F.abs("ms") < float("inf"))).withColumn("ms", F.greatest(F.lit(0.0), "ms"))
    by = [*keys, "name"]
    base = finite.groupBy(F.struct(*by).alias("_k")).agg(F.count("*").alias("n"), F.max_by("ms", "seq").alias("latest"), F.avg("ms").alias("average"))
    ranks = nearest_ranks(finite, by, "ms", {f"p{p}": p / 100 for p in (95, 98, 99)})
    return base.join(ranks, "_k").select("_k.*", "n", "latest", "average", "p95", "p98", "p99")


def summary_order(summary: DataFrame) -> DataFrame:
    """The total first, then by name."""
    return summary.orderBy(F.col("name") != "total", "name")


def hotspot(stats: DataFrame, keys: list[str], stage: str, value: str, order: str) -> DataFrame:
    """The stage of the highest value in each group; the first by ``order`` of equals."""
    return stats.groupBy(*keys).agg(F.max(F.struct(F.col(value), (-F.col(order)).alias("o"), F.col(stage).alias("s")))["s"].alias("hotspot"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """Share of hits of summed counts; 0 without any."""
    total = F.sum(hits) + F.sum(misses)
    return F.when(total == 0, 0.0).otherwise(F.sum(hits) / total)


def counter_delta(counters: DataFrame, keys: list[str], order: str, counts: list[str], gauges: list[str]) -> DataFrame:
    """Each row's counts less those of the row before (the first row's are kept); gauges stay as they are."""
    parts = ranges.ranged(counters.select(*dict.fromkeys([*keys, order, *counts, *gauges])), keys, order)
    before = ranges.with_last(parts, order, {f"_before_{c}": c for c in counts})
    return before.select(*keys, order, *((F.col(c) - F.coalesce(f"_before_{c}", F.lit(0))).alias(c) for c in counts), *gauges)


def merge_counts(parts: DataFrame, keys: list[str], counts: str = "counts") -> DataFrame:
    """One map of summed counts per group, from maps of parts."""
    summed = parts.select(*keys, F.explode(counts).alias("name", "n")).groupBy(*keys, "name").agg(F.sum("n").alias("n"))
    return summed.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(counts))


def scoped_history(samples: DataFrame, keys: list[str], limit: int = 100) -> DataFrame:
    """The latest run of rows with one scope_key (a change of scope starts anew), its last ``limit`` rows, by seq."""
    parts = ranges.ranged(samples, keys, "seq")
    before = ranges.with_last(parts, "seq", {"_scope": "scope_key"})
    changes = before.where(F.col("_first") | ~F.col("scope_key").eqNullSafe(F.col("_scope")))
    since = changes.groupBy("_key").agg(F.max("seq").alias("_since"))
    run = parts.join(since, "_key").where(F.col("seq") >= F.col("_since"))
    return last_n(run, ["_key"], "seq", limit).select(*samples.columns)


def last_n(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of every key; Spark limits the groups of a task to n rows before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def monotonic(events: DataFrame, keys: list[str], order: str, ts: str) -> DataFrame:
    """Times raised to at least one more than the time before: max over earlier rows of (time - place) + place."""
    raised = ranges.with_running_maximum(ranges.ranged(events, keys, order), order, F.col(ts), "monotonic_ts")
    return raised.select(*events.columns, "monotonic_ts")


def unique_colors(px: DataFrame, bayer: int | None = None) -> DataFrame:
    """image_id and its number of distinct colours, exact; with ``bayer`` also threshold_colors, of distinct (threshold, colour).

    Colours are bits of words of 64 (by threshold), joined by or in hash aggregates of longs: an image has at most as many
    words as pixels, and at most 262 144 for each threshold.  Pixels are dealt by image and word before words are joined, as
    a task of the source would hold the words of all its images.
    """
    rgb = F.col("r").cast("long") * 65536 + F.col("g") * 256 + F.col("b")
    place = F.lit(0) if bayer is None else (F.pmod("y", F.lit(bayer)) * bayer + F.pmod("x", F.lit(bayer)))
    bit = F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(rgb, F.lit(64)).cast("int")), F.lit(0).cast("long"))
    parts = int(px.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = px.select("image_id", F.shiftright(rgb, 6).alias("_word"), place.alias("_t"), bit.alias("_bit")).repartition(parts, "image_id", "_word")
    words = dealt.groupBy("image_id", "_word", "_t").agg(F.bit_or("_bit").alias("_bits"))
    if bayer is None:
        return words.groupBy("image_id").agg(F.sum(F.bit_count("_bits").cast("long")).alias("colors"))
    merged = words.groupBy("image_id", "_word").agg(F.bit_or("_bits").alias("_any"), F.sum(F.bit_count("_bits").cast("long")).alias("_pairs"))
    return merged.groupBy("image_id").agg(F.sum(F.bit_count("_any").cast("long")).alias("colors"), F.sum("_pairs").alias("threshold_colors"))


_FNV, _START, _LOW = 16777619, 2166136261, 512


def _steps(tables: np.ndarray, power: np.ndarray, then: np.ndarray, then_power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folds of one run after another: state h becomes h * power + table[low bits of h], in 32 bits."""
    low = (np.arange(_LOW, dtype=np.uint64) * power[:, None] + tables) % np.uint64(_LOW)
    out = tables * then_power[:, None] + np.take_along_axis(then, low.astype(np.intp), 1)
    return out & np.uint64(0xFFFFFFFF), power * then_power & np.uint64(0xFFFFFFFF)


def _row_folds(idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables and powers of rows of indices (rows x width).  Only the low bits of a state meet the xor with an index."""
    state = np.tile(np.arange(_LOW, dtype=np.uint64), (len(idx), 1))
    for column in (idx + 1).astype(np.uint64).T:
        state = ((state ^ column[:, None]) * np.uint64(_FNV)) & np.uint64(0xFFFFFFFF)
    power = np.full(len(idx), pow(_FNV, idx.shape[1], 1 << 32), np.uint64)
    return (state - np.arange(_LOW, dtype=np.uint64) * power[:, None]) & np.uint64(0xFFFFFFFF), power


def _in_order(table: pa.Table, by: str) -> tuple[np.ndarray, np.ndarray]:
    """The fold of the rows (by, power, fold) of a group, one after the other."""
    table = table.sort_by(by)
    folds = np.stack([np.frombuffer(x, np.uint32).astype(np.uint64) for x in table["fold"].to_pylist()])
    powers = table["power"].to_numpy().astype(np.uint64)
    done, power = folds[:1], powers[:1]
    for k in range(1, len(folds)):
        done, power = _steps(done, power, folds[k : k + 1], powers[k : k + 1])
    return done[0], power[0]


def index_checksum(indexed: DataFrame) -> DataFrame:
    """image_id, checksum: a 32-bit fold of idx + 1 in row order, of indices up to 255.

    An image row becomes a function of the state before it: a table by the state's nine low bits and a multiplier.  These
    are put together by bands of rows and then by image, so no array is longer than an image row.
    """
    rows = bands.packed(indexed, ["idx"]).select("image_id", "y", F.col("p.idx").alias("idx"))
    image = rows.schema["image_id"].dataType.simpleString()

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, flat = bands.flat(pa.chunked_array([batch.column("idx")]))
            first = np.cumsum(n) - n
            out, power = [b""] * len(n), np.zeros(len(n), np.int64)
            for width in np.unique(n):
                own = np.flatnonzero(n == width)
                for part in np.array_split(own, len(own) // 256 + 1):
                    tables, powers = _row_folds(flat[first[part][:, None] + np.arange(width)].astype(np.int64))
                    power[part] = powers.astype(np.int64)
                    for k, table in zip(part.tolist(), tables.astype(np.uint32), strict=True):
                        out[k] = table.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("y"), pa.array(power), pa.array(out, pa.binary())], ["image_id", "y", "power", "fold"])

    def joined(table: pa.Table) -> pa.Table:
        fold, power = _in_order(table, "y")
        return pa.table({"image_id": table["image_id"][:1], "band": table["band"][:1], "power": [int(power)], "fold": pa.array([fold.astype(np.uint32).tobytes()], pa.binary())})

    def closed(table: pa.Table) -> pa.Table:
        fold, power = _in_order(table, "band")
        return pa.table({"image_id": table["image_id"][:1], "checksum": [int((_START * int(power) + int(fold[_START % _LOW])) & 0xFFFFFFFF)]})

    folded = rows.mapInArrow(folds, f"image_id {image}, y int, power long, fold binary").withColumn("band", F.floor(F.col("y") / bands.BAND))
    by_band = folded.groupBy("image_id", "band").applyInArrow(joined, f"image_id {image}, band long, power long, fold binary")
    return by_band.groupBy("image_id").applyInArrow(closed, f"image_id {image}, checksum long")


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """image_id, pixels, same of two indexed results; a pixel that only one has does not agree.

    Image rows are compared by digests (counts, sums and exclusive ors of hashes), which are aggregated where the pixels
    are; only rows whose digests differ are joined by pixel.
    """

    def digests(indexed: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64("x", "idx")
        return indexed.groupBy("image_id", "y").agg(F.count("*").alias(f"{name}n"), F.struct(F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).alias(name))

    rows = save(digests(left, "l").join(digests(right, "r"), ["image_id", "y"], "full"), "digests")
    alike = (F.col("ln") == F.col("rn")) & (F.col("l") == F.col("r"))
    equal = rows.where(alike).groupBy("image_id").agg(F.sum("ln").alias("pixels"), F.sum("ln").alias("same"))
    opened = rows.where(~F.coalesce(alike, F.lit(False))).select("image_id", "y")
    a, b = (side.join(opened, ["image_id", "y"], "left_semi").withColumnRenamed("idx", name) for side, name in ((left, "i"), (right, "j")))
    both = a.join(b, ["image_id", "y", "x"], "full").groupBy("image_id").agg(F.count("*").alias("pixels"), F.count_if(F.col("i").eqNullSafe(F.col("j"))).alias("same"))
    return equal.unionByName(both).groupBy("image_id").agg(F.sum("pixels").alias("pixels"), F.sum("same").alias("same"))


def palette_usage(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """ord, name, pixels of every palette colour, also unused ones."""
    counted = indexed.groupBy("idx").agg(F.count("*").alias("pixels"))
    return palette.join(counted, palette["ord"] == counted["idx"], "left").select("ord", "name", F.coalesce("pixels", F.lit(0)).alias("pixels"))


def memory_estimate(jobs: DataFrame) -> DataFrame:
    """job_id and bytes of source, resized, indices, vectors and diffusion work, of (source_width, ..., out_height, dither, in_vectors)."""
    source, out = F.col("source_width").cast("long") * F.col("source_height"), F.col("out_width").cast("long") * F.col("out_height")
    diffuses = F.col("dither").isin("floyd-steinberg", "sierra", "sierra-lite")
    return jobs.select("job_id", (source * 4).alias("source_bytes"), (out * 4).alias("resized_bytes"), out.alias("index_bytes"), F.when(F.col("in_vectors"), out * 12).otherwise(0).alias("vector_bytes"), F.when(diffuses, out * 12).otherwise(0).alias("work_bytes"))


def replayed_ms(samples: DataFrame) -> DataFrame:
    """Time that reuse saved: seq and the sum of the timings marked as replayed."""
    saved = F.aggregate(F.filter("timings", lambda t: t["replayed"]), F.lit(0.0), lambda a, t: a + t["ms"])
    return samples.select("seq", saved.alias("replayed_ms"))


def mean_rows(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in measures))


def stage_table(stats: DataFrame, keys: list[str], stage: str, value: str, stages: list[str]) -> DataFrame:
    """One row per group, one column per stage: the shape of the CSV report.  Write it with ``.write.csv(header=True)``."""
    return stats.groupBy(*keys).pivot(stage, stages).agg(F.first(value))
