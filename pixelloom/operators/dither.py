"""Quantizing without error diffusion: direct, ordered and random, in bytes or in a colour space.

Everything is a column expression over the pixel, except the noise counter (two-level prefix count) and the adaptive
mask (packed image rows in bands with a halo, compared as arrays).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.color import SPACES, clamp_byte, squared_distance
from pixelloom.functions.pixel import bayer_threshold, composited, is_transparent, noise
from pixelloom.operators import bands, match
from pixelloom.schemas import EPSILON
from pixelloom.sources.palettes import Swatch

RGB_SCALE, VECTOR_SCALE = 96.0, 0.25


@dataclass(frozen=True)
class Settings:
    """How to quantize; strength is in percent."""

    color_space: str = "oklab"
    dither: str = "none"
    strength: float = 100
    use_color_space: bool = False
    placement: str = "everywhere"
    radius: float = 3
    threshold: float = 12
    softness: float = 8
    serpentine: bool = True
    seed: int = 0xC0FFEE42
    alpha_mode: str = "preserve"
    alpha_threshold: int = 0
    matte: tuple[int, int, int] = (255, 255, 255)

    @property
    def in_vectors(self) -> bool:
        """Dither in the colour space; weighted-rgb has no such form."""
        return self.use_color_space and self.color_space != "weighted-rgb" and self.dither != "none"


def masked_index(palette: Sequence[Swatch]) -> int:
    """What a transparent pixel becomes: the transparent entry, else the darkest visible colour."""
    clear = [s.ord for s in palette if s.kind == "transparent"]
    return clear[0] if clear else min((sum(s.rgb), s.ord) for s in palette if s.visible)[1]


def only_transparent(px: DataFrame, palette: Sequence[Swatch]) -> DataFrame | None:
    """All pixels transparent, if the palette has no visible colour; None if it has one.  A palette of nothing is an error."""
    if any(s.visible for s in palette):
        return None
    clear = [s.ord for s in palette if s.kind == "transparent"]
    if not clear:
        raise ValueError("the palette has no visible colour and no Transparent")
    return px.select("image_id", "y", "x", F.lit(clear[0]).cast("int").alias("idx"))


def random_steps(px: DataFrame, masked: Column) -> DataFrame:
    """Adds ``step``, the 1-based number of an unmasked pixel in row order of its image; null for masked pixels.

    Counts by row are summed over the rows before, so that no window spans a whole image's pixels.
    """
    flagged = px.withColumn("_on", ~masked)
    rows = flagged.groupBy("image_id", "y").agg(F.count_if("_on").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("image_id").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.select("image_id", "y", before.alias("_before"))
    within = F.sum(F.col("_on").cast("int")).over(Window.partitionBy("image_id", "y").orderBy("x"))
    return flagged.withColumn("_within", within).join(starts, ["image_id", "y"]).withColumn("step", F.when(F.col("_on"), F.col("_before") + F.col("_within"))).drop("_on", "_within", "_before")


def smoothed(low: float, high: float, v: np.ndarray) -> np.ndarray:
    if low == high:
        return np.where(v >= high, 1.0, 0.0)
    t = np.clip((v - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - t * 2)


def differences(vectors: np.ndarray, radius: int, space: str) -> np.ndarray:
    """Mean distance of every pixel (rows x width x 3) from its eight neighbours at the radius; places beyond an edge are the edge."""
    height, width, _ = vectors.shape
    total = np.zeros((height, width))
    for dx in (-radius, 0, radius):  # the order of the sums is by column, then by row
        for dy in (-radius, 0, radius):
            if dx or dy:
                y, x = np.clip(np.arange(height) + dy, 0, height - 1), np.clip(np.arange(width) + dx, 0, width - 1)
                around = vectors[y[:, None], x]
                total += np.nan_to_num(np.sqrt(squared_distance(np.moveaxis(vectors, -1, 0), np.moveaxis(around, -1, 0), space)))
    return total / 8


def band_vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors (rows x width x 3) of a band from its columns y, x, v0, v1 and v2 (lists), and the row and x of each pixel; what is missing is NaN."""
    y = table["y"].to_numpy()
    n, x = bands.flat(table["x"])
    row = np.repeat(y - y.min(), n)
    out = np.full((int(y.max() - y.min()) + 1, int(x.max()) + 1, 3), np.nan)
    for k in range(3):
        out[row, x, k] = bands.flat(table[f"v{k}"])[1]
    return out, row, x


def mask_radius(s: Settings) -> int:
    return max(1, math.floor(s.radius + 0.5))


def adaptive_mask(px: DataFrame, palette: Sequence[Swatch], s: Settings) -> DataFrame:
    """Adds ``mask`` (0 to 1): how much the colour differs from its eight neighbours at the radius.

    Images are complete rectangles; a missing neighbour adds nothing.
    """
    radius = mask_radius(s)
    diagonal = max(math.hypot(*match.axis_ranges(match.palette_vectors(px.sparkSession, palette, s.color_space))), EPSILON)
    others = [c for c in px.columns if c not in ("image_id", "y", "x")]
    vector = [v.alias(f"_v{k}") for k, v in enumerate(SPACES[s.color_space](tuple(F.col(c) for c in "rgb")))]
    rows = bands.packed(px, [*others, *vector]).select("image_id", "y", F.transform("p", lambda e: F.struct(e["x"].alias("x"), *(e[c].alias(c) for c in others))).alias("p"), F.col("p.x").alias("x"), *(F.col(f"p._v{k}").alias(f"v{k}") for k in range(3)))
    dealt = bands.with_halo(rows, F.lit(radius), only_own=("p",))
    low, high, space = s.threshold - s.softness, s.threshold + s.softness, s.color_space

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in bands.groups(batches, ("image_id", "band")):
            own = table["own"].to_numpy()
            if own.any():
                vectors, row, x = band_vectors(table)
                mask = smoothed(low, high, differences(vectors, radius, space) / diagonal * 100)[row, x]
                length, _ = bands.flat(table["x"])
                mine = table.filter(pa.array(own))
                masks = bands.lists(length[own], mask[np.repeat(own, length)])
                yield from mine.select(["image_id", "y", "p"]).append_column("mask", masks).combine_chunks().to_batches()

    image, pixel = dealt.schema["image_id"].dataType.simpleString(), dealt.schema["p"].dataType.simpleString()
    masked = dealt.mapInArrow(run, f"image_id {image}, y int, p {pixel}, mask array<double>")
    return masked.select("image_id", "y", F.explode(F.arrays_zip("p", "mask")).alias("e")).select("image_id", "y", "e.p.*", "e.mask").select(*px.columns, "mask")


def quantize(px: DataFrame, palette: Sequence[Swatch], s: Settings) -> DataFrame:
    """image_id, y, x, idx of direct, ordered or random quantizing; error diffusion is in ``diffusion``."""
    if (clear := only_transparent(px, palette)) is not None:
        return clear
    masked = is_transparent(F.col("a"), s.alpha_mode, s.alpha_threshold)
    strength = s.strength / 100
    plain = s.dither == "none" or strength <= 0
    source = px
    if not plain and s.placement == "adaptive":
        source = adaptive_mask(px, palette, s)
    elif not plain:
        source = px.withColumn("mask", F.lit(1.0))
    if not plain and s.dither == "random":
        source = random_steps(source, masked).withColumn("_t", noise(s.seed, F.col("step")))
    elif not plain:
        source = source.withColumn("_t", bayer_threshold(int(s.dither.rpartition("-")[2]), F.col("y"), F.col("x")))
    seen = composited(tuple(F.col(c) for c in "rgb"), F.col("a"), s.alpha_mode, s.matte)
    source = source.withColumns({f"_{c}": v for c, v in zip("rgb", seen, strict=True)})
    columns = ("_r", "_g", "_b")
    rgb = tuple(F.col(c) for c in columns)
    if plain:
        out = match.nearest(source, palette, s.color_space, columns)
    elif s.in_vectors:
        ranges = match.axis_ranges(match.palette_vectors(px.sparkSession, palette, s.color_space))
        shift = F.col("_t") * strength * F.col("mask") * VECTOR_SCALE
        moved = [v + shift * r for v, r in zip(SPACES[s.color_space](rgb), ranges, strict=True)]
        out = match.nearest_vector(source.withColumns({f"_v{k}": v for k, v in enumerate(moved)}), palette, s.color_space, ("_v0", "_v1", "_v2"))
    else:
        moved = source.withColumns({c: clamp_byte(F.col(c) + F.col("_t") * (RGB_SCALE * strength) * F.col("mask")) for c in columns})
        out = match.nearest(moved, palette, s.color_space, columns)
    return out.select("image_id", "y", "x", F.when(masked, masked_index(palette)).otherwise(F.col("idx")).cast("int").alias("idx"))
