"""Alpha, noise, thresholds and filters as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.functions.color import Triple, clamp_byte

MASK = 0xFFFFFFFF


def premultiply(rgb: Triple, a: Column) -> Triple:
    return tuple(F.when(a == 255, c).otherwise(F.floor(c * (a / 255.0) + 0.5)).cast("int") for c in rgb)


def blend_matte(rgb: Triple, a: Column, matte: Triple) -> Triple:
    opacity = a / 255.0
    return tuple(F.when(a == 255, c).otherwise(F.floor(c * opacity + m * (F.lit(1.0) - opacity) + 0.5)).cast("int") for c, m in zip(rgb, matte, strict=True))


def unpremultiply(rgb: Triple, a: Column) -> tuple[Column, Column, Column, Column]:
    """Bytes of premultiplied sums; nothing is left of a transparent pixel."""
    share = a / 255.0
    return (*(F.when(a <= 0, 0).otherwise(clamp_byte(c / share)) for c in rgb), F.when(a <= 0, 0).otherwise(clamp_byte(a)))


def composited(rgb: Triple, a: Column, alpha_mode: str, matte: tuple[int, int, int]) -> Triple:
    """The colour that is matched to the palette."""
    if alpha_mode == "premultiplied":
        return premultiply(rgb, a)
    return rgb if alpha_mode == "preserve" else blend_matte(rgb, a, tuple(F.lit(float(m)) for m in matte))


def is_transparent(a: Column, alpha_mode: str, threshold: int) -> Column:
    return a <= threshold if alpha_mode == "preserve" else F.lit(False)


def _times(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of 32-bit values; the factors are split, as a 64-bit product overflows under ANSI."""
    high, low = F.shiftright(a, 16), a.bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft((high * b).bitwiseAND(F.lit(0xFFFF)), 16) + low * b).bitwiseAND(F.lit(MASK))


def noise(seed: int, step: Column) -> Column:
    """Uniform in [-0.5, 0.5): the value of a counter-based generator at a step (from 1)."""
    state = (F.lit(seed & MASK) + _times(step.cast("long").bitwiseAND(F.lit(MASK)), F.lit(0x6D2B79F5))).bitwiseAND(F.lit(MASK))
    v = _times(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))
    v = v.bitwiseXOR((v + _times(v.bitwiseXOR(F.shiftright(v, 7)), v.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)))
    return v.bitwiseXOR(F.shiftright(v, 14)) / 4294967296.0 - 0.5


def bayer_matrix(n: int) -> list[list[int]]:
    """The ordered threshold matrix of side n (a power of two), by its recursion."""
    matrix = [[0]]
    while len(matrix) < n:
        top = [[4 * v for v in row] + [4 * v + 2 for v in row] for row in matrix]
        matrix = top + [[4 * v + 3 for v in row] + [4 * v + 1 for v in row] for row in matrix]
    return matrix


def bayer_threshold(n: int, y: Column, x: Column, centred: bool = True) -> Column:
    flat = [(v + 0.5) / (n * n) - (0.5 if centred else 0.0) for row in bayer_matrix(n) for v in row]
    return F.element_at(F.array(*map(F.lit, flat)), ((y % n) * n + x % n + 1).cast("int"))


def smoothstep(low: float, high: float, v: Column) -> Column:
    if low == high:
        return F.when(v >= high, 1.0).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))
    return t * t * (F.lit(3.0) - t * 2)


def sinc(d: Column) -> Column:
    return F.when(d == 0, 1.0).otherwise(F.sin(d * math.pi) / (d * math.pi))


def lanczos(d: Column, radius: int) -> Column:
    return F.when(F.abs(d) >= radius, 0.0).otherwise(sinc(d) * sinc(d / radius))
