"""Dither previews: how a palette and a way of dithering look on an image, by the preview's own scale.

Ordered and random thresholds shift by twice the quantizer's offset, every pixel is opaque and takes a random number, and
error diffusion is in bytes with errors of unclamped values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.color import SPACES, clamp_byte
from pixelloom.functions.pixel import bayer_threshold, noise
from pixelloom.operators import diffusion, dither, match
from pixelloom.operators.dither import RGB_SCALE, VECTOR_SCALE, Settings
from pixelloom.sources.palettes import Swatch

SCALE = 2 * RGB_SCALE


def sample(px: DataFrame, palette: Sequence[Swatch], s: Settings) -> DataFrame:
    """image_id, y, x, idx of the preview.  In a colour space the nearest is that by plain squares, whatever the space.

    The palette has a visible colour; alpha, placement and matte are not looked at.
    """
    if not any(p.visible for p in palette):
        raise ValueError("the palette has no visible colour")
    px = px.select("image_id", "y", "x", *(F.col(c).cast("double").alias(c) for c in "rgb"), F.lit(255).alias("a"))
    strength = s.strength / 100
    if s.dither in diffusion.KERNELS and strength > 0:
        plain = Settings(color_space=s.color_space, dither=s.dither, strength=s.strength, serpentine=s.serpentine)
        return diffusion.quantize(px, palette, plain, unclamped=True)
    if s.dither == "none" or s.dither in diffusion.KERNELS:
        moved = px.withColumns({c: clamp_byte(F.col(c)) for c in "rgb"})
        return match.nearest(moved, palette, s.color_space).select("image_id", "y", "x", "idx")
    if s.dither == "random":
        drawn = dither.random_steps(px, F.lit(False)).withColumn("_t", noise(s.seed, F.col("step")))
    else:
        drawn = px.withColumn("_t", bayer_threshold(int(s.dither.rpartition("-")[2]), F.col("y"), F.col("x")))
    shift = F.col("_t") * (SCALE * strength)
    if not s.in_vectors:
        moved = drawn.withColumns({c: clamp_byte(F.col(c) + shift) for c in "rgb"})
        return match.nearest(moved, palette, s.color_space).select("image_id", "y", "x", "idx")
    match.limit_methods(px.sparkSession)
    vectors = match.palette_vectors(px.sparkSession, palette, s.color_space)
    at = SPACES[s.color_space](tuple(clamp_byte(F.col(c)) for c in "rgb"))
    moved = drawn.withColumns({f"_v{k}": v + shift / SCALE * VECTOR_SCALE * r for k, (v, r) in enumerate(zip(at, match.axis_ranges(vectors), strict=True))})
    far = moved.withColumn("_d", match.distances(tuple(F.col(f"_v{k}") for k in range(3)), vectors, "srgb"))
    return far.select("image_id", "y", "x", match.first_minimum(F.col("_d"), [p.ord for p in palette if p.visible]).cast("int").alias("idx"))
