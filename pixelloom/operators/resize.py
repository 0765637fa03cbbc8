"""Resizing one axis after the other, in place.

A source pixel knows which targets have it among their taps: these are exploded from its coordinate with their weights,
as column expressions, and summed by target with partial aggregation.  So the pixels are shuffled once by image row and
once by target (branches of images: once by image), and the only join is that with the images' sizes (a row an image).  The coordinate of target t is
``start + (t + 0.5) * scale - 0.5``; taps outside the source take its edge pixel.  :func:`taps` is the same as a table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.color import clamp_byte
from pixelloom.functions.pixel import lanczos, unpremultiply
from pixelloom.operators.geometry import image_sizes

MODES = ("nearest", "bilinear", "area", "lanczos2", "lanczos3", "lanczos2-scale-aware", "lanczos3-scale-aware")
MAX_TAPS = 64
#: What the branches of images are grouped by.
KEYS = ("image_id", "slot", "branch")


def _settled(v: Column) -> Column:
    """A sum without the last bits, which depend on the order of its terms: halves then round alike on every run."""
    return F.round(v, 9)


def _targets(sizes: DataFrame, side: str, count: int, crop: tuple[float, float] | None) -> DataFrame:
    """image_id, t, pos, scale, side for one axis; crop is (start, length)."""
    start, length = (F.lit(0.0), F.col(side).cast("double")) if crop is None else (F.lit(float(crop[0])), F.lit(float(crop[1])))
    return sizes.select("image_id", F.col(side).alias("n"), (length / count).alias("scale"), start.alias("start"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("t")).withColumn("pos", F.col("start") + (F.col("t") + 0.5) * F.col("scale") - 0.5)


def _edge(i: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.col("n") - 1, i)).cast("int")


def taps(sizes: DataFrame, side: str, count: int, mode: str, crop: tuple[float, float] | None = None) -> DataFrame:
    """image_id, t (target), s (source index), w (weight), one row per tap; edge pixels may serve several taps."""
    targets = _targets(sizes, side, count, crop)
    if mode == "nearest":
        return targets.select("image_id", "t", _edge(F.floor(F.col("pos") + 0.5)).alias("s"), F.lit(1.0).alias("w"))
    if mode == "bilinear":
        low = F.floor("pos")
        part = F.col("pos") - low
        both = F.array(F.struct(low.alias("i"), (F.lit(1.0) - part).alias("w")), F.struct((low + 1).alias("i"), part.alias("w")))
        return targets.select("image_id", "t", "n", F.explode(both).alias("p")).select("image_id", "t", _edge(F.col("p.i")).alias("s"), "p.w")
    if mode == "area":
        window = F.sequence(F.floor(F.col("pos") - F.col("scale") / 2), F.ceil(F.col("pos") + F.col("scale") / 2))
        return targets.select("image_id", "t", "n", F.explode(window).alias("i")).select("image_id", "t", _edge(F.col("i")).alias("s"), F.lit(1.0).alias("w"))
    radius, aware = int(mode[7]), mode.endswith("aware")
    stretch = F.greatest(F.lit(1.0), F.col("scale")) if aware else F.lit(1.0)
    n_taps = F.least(F.lit(MAX_TAPS), (F.ceil(radius * stretch) * 2).cast("int"))
    wide = targets.withColumns({"stretch": stretch, "taps": n_taps})
    first = F.floor("pos") - F.col("taps") / 2 + 1
    each = wide.select("*", F.explode(F.sequence(first.cast("long"), (first + F.col("taps") - 1).cast("long"))).alias("i"))
    return each.select("image_id", "t", _edge(F.col("i")).alias("s"), lanczos((F.col("pos") - F.col("i")) / F.col("stretch"), radius).alias("w"))


def _spread(px: DataFrame, c: str, side: str, count: int | Column, mode: str, crop: tuple | None) -> DataFrame:
    """A row for each pixel and target of one axis that taps it: adds ``t`` and the weight ``w``; edge pixels sum their taps.

    px has the coordinate ``c`` and the side length ``side``; crop is (start, length), numbers or columns, as is count.
    """
    at, n = F.col(c), F.col(side)
    start, length = (F.lit(0.0), n.cast("double")) if crop is None else (F.lit(v).cast("double") for v in crop)
    scale = length / count
    radius = int(mode[7]) if mode.startswith("lanczos") else 0
    stretch = F.greatest(F.lit(1.0), scale) if mode.endswith("aware") else F.lit(1.0)
    n_taps = F.least(F.lit(MAX_TAPS), (F.ceil(radius * stretch) * 2).cast("int"))
    reach = {"nearest": F.lit(1.0), "bilinear": F.lit(2.0), "area": scale / 2 + 2}.get(mode, n_taps / 2 + 1)
    target = lambda i: (i - start + 0.5) / scale - 0.5
    first = F.when(at == 0, 0).otherwise(F.greatest(F.lit(0), F.floor(target(at - reach)))).cast("int")
    last = F.when(at == n - 1, count - 1).otherwise(F.least(F.lit(count - 1), F.ceil(target(at + reach)))).cast("int")
    every = px.select("*", F.explode(F.when(first <= last, F.sequence(first, last))).alias("t"))
    every = every.withColumn("_pos", start + (F.col("t") + 0.5) * scale - 0.5)
    pos = F.col("_pos")
    low, high = {
        "nearest": (F.floor(pos + 0.5), F.floor(pos + 0.5)),
        "bilinear": (F.floor(pos), F.floor(pos) + 1),
        "area": (F.floor(pos - scale / 2), F.ceil(pos + scale / 2)),
    }.get(mode, (F.floor(pos) - (n_taps / 2).cast("long") + 1, F.floor(pos) + (n_taps / 2).cast("long")))
    if mode == "bilinear":
        weight = lambda i: F.when(i == F.floor(pos), F.lit(1.0) - (pos - F.floor(pos))).otherwise(pos - F.floor(pos))
    elif radius:
        weight = lambda i: lanczos((pos - i) / stretch, radius)
    else:
        weight = lambda i: F.lit(1.0)
    taps_here = F.col("_to") - F.col("_from")
    summed = F.aggregate(F.sequence("_from", "_to"), F.lit(0.0), lambda total, i: total + weight(i))
    every = every.withColumns({"_from": F.when(at == 0, low).otherwise(F.greatest(low, at.cast("long"))), "_to": F.when(at == n - 1, high).otherwise(F.least(high, at.cast("long")))}).where(taps_here >= 0)
    return every.withColumn("w", F.when(taps_here == 0, weight(F.col("_from"))).otherwise(summed)).drop("_pos", "_from", "_to")


def _sized(px: DataFrame) -> DataFrame:
    """Pixels with the width and height of their image and whether it is opaque throughout."""
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.bool_and(F.col("a") == 255).alias("opaque"))
    return px.join(sizes, "image_id")


def resize(px: DataFrame, width: int, height: int, mode: str = "bilinear", crop: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Pixels of width x height; crop is (x, y, width, height) within the source, which stays readable around it."""
    cx, cy = (None, None) if crop is None else ((crop[0], crop[2]), (crop[1], crop[3]))
    parts = _resized(_sized(px), ("image_id",), width, height, mode, cx, cy, ())
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def resize_branches(px: DataFrame, branches: DataFrame, finish: Callable[[DataFrame], DataFrame] = lambda done: done) -> DataFrame:
    """branch, y, x, r, g, b, a of every branch (branch, image_id, width, height, resize, crop_x, crop_y, crop_width, crop_height).

    Sizes and crops are columns; the plan has a part for each mode that occurs.  A null crop is the whole image.  Pixels
    are shuffled once, by image and, where there are fewer images than partitions, by slot: a slot takes some of the
    image's branches.  All sums are grouped within that, so neither taps nor targets are shuffled.  ``finish`` is applied
    to the part of each mode (with the columns ``KEYS`` instead of branch alone), before the parts are put together.
    """
    whole = {"x": ("width", "crop_x", "crop_width"), "y": ("height", "crop_y", "crop_height")}
    images, most = branches.select("image_id").distinct().count(), int(px.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, -(-most // max(images, 1)))
    asked = branches.select("branch", "image_id", F.pmod(F.xxhash64("branch"), F.lit(slots)).cast("int").alias("slot"), F.col("width").alias("_width"), F.col("height").alias("_height"), "resize", *(c for _, start, length in whole.values() for c in (start, length)))
    dealt = _sized(px).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).repartition("image_id", "slot")
    sized = dealt.join(asked, ["image_id", "slot"])
    for c, (side, start, length) in whole.items():
        sized = sized.withColumns({f"_{c}0": F.coalesce(F.col(start).cast("double"), F.lit(0.0)), f"_{c}n": F.coalesce(F.col(length).cast("double"), F.col(side).cast("double"))})
    modes = [r["resize"] for r in branches.select("resize").distinct().collect()]  # at most len(MODES)
    carried = ("_height", "_y0", "_yn")
    cx, cy = ((F.col(f"_{c}0"), F.col(f"_{c}n")) for c in "xy")
    out = None
    for mode in [m for m in MODES if m in modes] or MODES[:1]:
        parts = _resized(sized.where(F.col("resize") == mode), KEYS, F.col("_width"), F.col("_height"), mode, cx, cy, carried)
        for done in map(finish, parts):
            out = done if out is None else out.unionByName(done)
    return out.drop("image_id", "slot")


def _resized(sized: DataFrame, keys: tuple[str, ...], width, height, mode: str, cx, cy, carried: tuple[str, ...]) -> list[DataFrame]:
    if mode == "nearest":
        columns = _spread(sized, "x", "width", width, mode, cx).withColumnRenamed("t", "tx").drop("w")
        return [_spread(columns, "y", "height", height, mode, cy).select(*keys, F.col("t").alias("y"), F.col("tx").alias("x"), "r", "g", "b", "a")]
    if mode != "area":
        return [_separable(sized, keys, width, height, mode, cx, cy, carried)]
    span = lambda side, c: F.col(side) if c is None else F.lit(c[1]).cast("double")
    grows = (span("width", cx) / width < 1) & (span("height", cy) / height < 1)  # such images are bilinear
    return [_separable(sized.where(~grows), keys, width, height, "area", cx, cy, carried), _separable(sized.where(grows), keys, width, height, "bilinear", cx, cy, carried)]


def _separable(sized: DataFrame, keys: tuple[str, ...], width, height, mode: str, cx, cy, carried: tuple[str, ...]) -> DataFrame:
    """Rows first, then columns.  Colours are weighted by alpha, and plainly too where all taps are opaque.

    For lanczos the whole image counts as opaque or not, for bilinear the taps of a pixel; area always weights by alpha.
    ``carried`` are columns of the keys that the second axis needs.
    """
    opaque = {"bilinear": F.col("a") == 255, "area": F.lit(False)}.get(mode, F.col("opaque"))
    alpha = F.col("a") / 255.0
    plain, soft = [f"o{c}" for c in "rgb"], [f"p{c}" for c in "rgb"]
    values = (*plain, *soft, "a", "n")
    first = [width] if isinstance(width, Column) else []
    first += list(cx) if cx is not None and isinstance(cx[0], Column) else []
    source = sized.select(
        *keys, "y", "x", "width", "height", *carried, *first, opaque.alias("opaque"), *(F.col(c).cast("double").alias(o) for c, o in zip("rgb", plain, strict=True)),
        *((F.col(c) * alpha).alias(p) for c, p in zip("rgb", soft, strict=True)), F.col("a").cast("double").alias("a"), F.lit(1.0).alias("n"),
    )

    def summed(rows: DataFrame, *at, keep: tuple[str, ...] = ()) -> DataFrame:
        return rows.groupBy(*keys, *at).agg(*(F.sum(F.col(v) * F.col("w")).alias(v) for v in values), F.bool_and("opaque").alias("opaque"), *(F.any_value(c).alias(c) for c in keep))

    rows = summed(_spread(source, "x", "width", width, mode, cx).withColumnRenamed("t", "tx"), "y", "tx", keep=("height", *carried))
    sums = summed(_spread(rows, "y", "height", height, mode, cy), F.col("t"), "tx")
    mean = {v: _settled(F.col(v) / F.col("n")) for v in values[:-1]}
    mixed = unpremultiply(tuple(mean[p] for p in soft), mean["a"])
    rgb = [F.when(F.col("opaque"), clamp_byte(mean[o])).otherwise(m).alias(c) for c, o, m in zip("rgb", plain, mixed, strict=False)]
    return sums.select(*keys, F.col("t").alias("y"), F.col("tx").alias("x"), *rgb, F.when(F.col("opaque"), 255).otherwise(mixed[3]).alias("a"))


def tap_count(scale: float, radius: int) -> int:
    """Taps of a scale-aware filter on one axis."""
    return min(MAX_TAPS, math.ceil(radius * max(1.0, scale)) * 2)
