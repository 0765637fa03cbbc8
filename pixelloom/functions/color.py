"""Colour spaces and distances as column expressions.

A space turns byte channels into three doubles; a distance compares two colours given in its space.  Both registries
map names to functions of Columns, so a caller may add a space without touching the operators.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]

# Matrices and weights.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
LMS_OF_OKLAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.291485548))
RGB_OF_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))
LUMA = {"weighted-rgb-601": (0.299, 0.587, 0.114), "weighted-rgb-709": (0.2126, 0.7152, 0.0722)}


def clamp_byte(v: Column) -> Column:
    """Nearest integer (halves up) within 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v + 0.5))).cast("int")


def srgb_to_linear(byte: Column) -> Column:
    c = byte / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    """The byte of a linear channel, clamped."""
    c = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    return clamp_byte(c * 255.0)


def _dot(row: tuple[float, float, float], v: Triple) -> Column:
    return v[0] * row[0] + v[1] * row[1] + v[2] * row[2]


def rgb_to_linear(rgb: Triple) -> Triple:
    return tuple(srgb_to_linear(c) for c in rgb)


def rgb_to_xyz(rgb: Triple) -> Triple:
    linear = rgb_to_linear(rgb)
    return tuple(_dot(row, linear) for row in XYZ)


def rgb_to_lab(rgb: Triple) -> Triple:
    def pivot(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16 / 116)

    x, y, z = (pivot(c / w) for c, w in zip(rgb_to_xyz(rgb), WHITE, strict=True))
    return y * 116 - 16, (x - y) * 500, (y - z) * 200


def rgb_to_oklab(rgb: Triple) -> Triple:
    linear = rgb_to_linear(rgb)
    lms = tuple(F.cbrt(_dot(row, linear)) for row in LMS)
    return tuple(_dot(row, lms) for row in OKLAB)


def rgb_to_oklch(rgb: Triple) -> Triple:
    lightness, a, b = rgb_to_oklab(rgb)
    return lightness, F.hypot(a, b), F.atan2(b, a)


def oklab_to_oklch(lab: Triple) -> Triple:
    """Hue in degrees, 0 to 360."""
    return lab[0], F.hypot(lab[1], lab[2]), F.pmod(F.degrees(F.atan2(lab[2], lab[1])) + 360.0, F.lit(360.0))


def oklch_to_oklab(lch: Triple) -> Triple:
    hue = F.radians(lch[2])
    return lch[0], lch[1] * F.cos(hue), lch[1] * F.sin(hue)


def oklab_to_rgb(lab: Triple) -> Triple:
    lms = tuple(F.pow(_dot(row, lab), F.lit(3.0)) for row in LMS_OF_OKLAB)
    return tuple(linear_to_srgb(_dot(row, lms)) for row in RGB_OF_LMS)


def weighted(rgb: Triple, weights: tuple[float, float, float]) -> Triple:
    return tuple(c * math.sqrt(w) for c, w in zip(rgb, weights, strict=True))


def rgb_to_hsv(rgb: Triple) -> Triple:
    """Hue in degrees, saturation and value in percent."""
    high, low = F.greatest(*rgb) / 255.0, F.least(*rgb) / 255.0
    return hue(rgb), F.when(high == 0, 0.0).otherwise((high - low) / high * 100), high * 100


def rgb_to_hsl(rgb: Triple) -> Triple:
    high, low = F.greatest(*rgb) / 255.0, F.least(*rgb) / 255.0
    light, delta = (high + low) / 2, high - low
    return hue(rgb), F.when(delta == 0, 0.0).otherwise(delta / (F.lit(1.0) - F.abs(light * 2 - 1)) * 100), light * 100


def hue(rgb: Triple) -> Column:
    r, g, b = (c / 255.0 for c in rgb)
    high, delta = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    sector = F.when(high == r, F.pmod((g - b) / delta, F.lit(6.0))).when(high == g, (b - r) / delta + 2).otherwise((r - g) / delta + 4)
    return F.when(delta == 0, 0.0).otherwise(sector * 60)


def _of_hue(h: Column, chroma: Column, base: Column) -> Triple:
    at = F.pmod(h, F.lit(360.0)) / 60
    middle = chroma * (F.lit(1.0) - F.abs(F.pmod(at, F.lit(2.0)) - 1))
    zero = chroma * 0.0
    by_sector = [(chroma, middle, zero), (middle, chroma, zero), (zero, chroma, middle), (zero, middle, chroma), (middle, zero, chroma), (chroma, zero, middle)]
    out = []
    for k in range(3):
        channel = by_sector[5][k]
        for n in range(4, -1, -1):
            channel = F.when(at < n + 1, by_sector[n][k]).otherwise(channel)
        out.append(clamp_byte((channel + base) * 255.0))
    return tuple(out)


def hsv_to_rgb(hsv: Triple) -> Triple:
    value, saturation = hsv[2] / 100, hsv[1] / 100
    chroma = value * saturation
    return _of_hue(hsv[0], chroma, value - chroma)


def hsl_to_rgb(hsl: Triple) -> Triple:
    light, saturation = hsl[2] / 100, hsl[1] / 100
    chroma = (F.lit(1.0) - F.abs(light * 2 - 1)) * saturation
    return _of_hue(hsl[0], chroma, light - chroma / 2)


def _as_double(rgb: Triple) -> Triple:
    return tuple(c.cast("double") for c in rgb)


#: Vector of a byte colour by colour space.
SPACES: dict[str, Callable[[Triple], Triple]] = {
    "srgb": _as_double,
    "weighted-rgb": _as_double,
    "weighted-rgb-601": lambda rgb: weighted(rgb, LUMA["weighted-rgb-601"]),
    "weighted-rgb-709": lambda rgb: weighted(rgb, LUMA["weighted-rgb-709"]),
    "linear-rgb": rgb_to_linear,
    "cielab": rgb_to_lab,
    "oklab": rgb_to_oklab,
    "oklch": rgb_to_oklch,
}


def euclidean(p: Triple, q: Triple) -> Column:
    d = [a - b for a, b in zip(p, q, strict=True)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def mean_red(p: Triple, q: Triple) -> Column:
    """Weights that lean on the mean red of the two colours."""
    dr, dg, db = (a - b for a, b in zip(p, q, strict=True))
    red = (p[0] + q[0]) / 2
    return (red / 256 + 2) * dr * dr + dg * dg * 4.0 + ((F.lit(255.0) - red) / 256 + 2) * db * db


def polar(p: Triple, q: Triple) -> Column:
    """Hue is circular and counts by the smaller chroma."""
    dl, dc, apart = p[0] - q[0], p[1] - q[1], F.abs(p[2] - q[2])
    dh = F.least(p[1], q[1]) * F.when(apart > math.pi, F.lit(2 * math.pi) - apart).otherwise(apart)
    return dl * dl + dc * dc + dh * dh


#: Squared distance by colour space, over the vectors of that space.
DISTANCES: dict[str, Callable[[Triple, Triple], Column]] = {space: euclidean for space in SPACES} | {"weighted-rgb": mean_red, "oklch": polar}


def vector(rgb: Triple, space: str) -> Triple:
    return SPACES[space](rgb)


def squared_distance(a: Sequence[np.ndarray], b: Sequence[np.ndarray], space: str) -> np.ndarray:
    """Squared distance of colours given by their three coordinates as arrays, which broadcast."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    if space == "weighted-rgb":
        red = (a[0] + b[0]) / 2
        return (2 + red / 256) * d[0] ** 2 + 4 * d[1] ** 2 + (2 + (255 - red) / 256) * d[2] ** 2
    if space == "oklch":
        apart = np.abs(d[2])
        turn = np.minimum(a[1], b[1]) * np.where(apart > np.pi, 2 * np.pi - apart, apart)
        return d[0] ** 2 + d[1] ** 2 + turn**2
    return d[0] ** 2 + d[1] ** 2 + d[2] ** 2
