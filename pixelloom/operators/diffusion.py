"""Error diffusion: dependent pixels within an image, parallel over images.

Pixels are packed by image row in the JVM.  Images of one size are dealt into bundles of about ``BUNDLE`` and the
bundles to the tasks; a task streams over the rows of its bundle and holds at most ``BLOCK`` of them and those that the
kernel reaches.  Colours are first turned into the dither space by Catalyst; the scan keeps its working values in float32.

Without serpentine rows a block of rows is scanned as a wavefront: row y runs so many columns behind row y - 1 that all
errors which it gets have been added before its own, and one numpy step takes a pixel of every row and image.  In
memory such a front is a strided slice.  With serpentine rows each row waits for the end of the one before, so there a
step takes the same pixel of all images of the bundle; few images are scanned by plain numbers instead, with the
answers for byte colours remembered.  Errors to the rows below are added a row at a time.  Every pixel gets its errors
in the order of a serial scan, so the results are the same bit for bit.

Images are complete rectangles; an image with missing or repeated pixels is an error, found by its count of pixels.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import color
from pixelloom.functions.pixel import composited, is_transparent
from pixelloom.operators import dither, match
from pixelloom.operators.dither import Settings
from pixelloom.sources.palettes import Swatch

#: Images that are scanned together; rows of a wavefront; fewer images are scanned by plain numbers.
BUNDLE = 64
BLOCK = 64
FEW = 6
#: The 64 byte colours that share their upper six bits.
_CELL = np.array([(r, g, b) for r in range(4) for g in range(4) for b in range(4)], float)

# Fixed values: (dx, dy, weight) of each kernel, for a scan from left to right.
KERNELS = {
    "floyd-steinberg": ((1, 0, 7 / 16), (-1, 1, 3 / 16), (0, 1, 5 / 16), (1, 1, 1 / 16)),
    "sierra": ((1, 0, 5 / 32), (2, 0, 3 / 32), (-2, 1, 2 / 32), (-1, 1, 4 / 32), (0, 1, 5 / 32), (1, 1, 4 / 32), (2, 1, 2 / 32), (-1, 2, 2 / 32), (0, 2, 3 / 32), (1, 2, 2 / 32)),
    "sierra-lite": ((1, 0, 2 / 4), (-1, 1, 1 / 4), (0, 1, 1 / 4)),
}


def nearest_to(vectors: np.ndarray, space: str) -> Callable[[np.ndarray], np.ndarray]:
    """A function from vectors (n x 3) to the position of the nearest colour of each, the first of equals."""
    p = tuple(np.asarray(vectors, float).T)
    return lambda v: color.squared_distance(tuple(v[:, k, None] for k in range(3)), p, space).argmin(1)


def byte_vectors(v: np.ndarray, space: str) -> np.ndarray:
    """Vectors of whole byte colours (n x 3), as the column expressions give them."""
    if space in ("srgb", "weighted-rgb"):
        return v
    if space in color.LUMA:
        return v * np.sqrt(color.LUMA[space])
    linear = _LINEAR[v.astype(np.intp)]
    if space == "linear-rgb":
        return linear
    if space == "cielab":
        t = linear @ np.array(color.XYZ).T / color.WHITE
        f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
        return np.column_stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])])
    lab = np.cbrt(linear @ np.array(color.LMS).T) @ np.array(color.OKLAB).T
    return lab if space == "oklab" else np.column_stack([lab[:, 0], np.hypot(lab[:, 1], lab[:, 2]), np.arctan2(lab[:, 2], lab[:, 1])])


_BYTES = np.arange(256) / 255.0
_LINEAR = np.where(_BYTES <= 0.04045, _BYTES / 12.92, ((_BYTES + 0.055) / 1.055) ** 2.4)


@dataclass
class Scan:
    """Scans bundles of images row by row."""

    kernel: Sequence[tuple[int, int, float]]
    vectors: np.ndarray  # of the visible colours, in the colour space
    targets: np.ndarray  # what errors are measured against: the vectors, or the byte colours
    ords: np.ndarray
    space: str
    as_bytes: bool
    serpentine: bool
    strength: float
    masked: int
    unclamped: bool = False  # errors of byte values are those of the values before they became bytes
    window: list = field(default_factory=list)  # rows read and not yet scanned

    def __post_init__(self):
        self.depth = max(dy for _, dy, _ in self.kernel)
        self.ahead = [(dx, weight) for dx, dy, weight in sorted(self.kernel, reverse=True) if dy == 0]
        self.below = [tap for tap in sorted(self.kernel, reverse=True) if tap[1] > 0]  # a pixel gets the error of the farthest dx first
        self.reach = max(abs(dx) for dx, _, _ in self.kernel)
        #: Columns that a row is behind the row above: its last error comes no later than the first of the row's own.
        self.lag = max(-dx for dx, _, _ in self.below) + max(dx for dx, _ in self.ahead)
        self.nearest = nearest_to(self.vectors, self.space)
        self.points = tuple(self.vectors.T)
        self.remembered: dict[int, bytes] = {}  # the nearest of 64 byte colours by their upper bits

    def add(self, y: int, images: list, work: np.ndarray, clear: np.ndarray, mask: np.ndarray) -> Iterator[tuple]:
        """Take row y of all images of the bundle: work is images x width x 3, clear and mask are images x width."""
        if y == 0:
            yield from self.finish()
        self.window.append((y, images, work, clear, mask * self.strength))
        if len(self.window) >= self.depth + (1 if self.serpentine else BLOCK):
            yield from self._scan(len(self.window) - self.depth)

    def finish(self) -> Iterator[tuple]:
        if self.window:
            yield from self._scan(len(self.window))

    def _scan(self, n: int) -> Iterator[tuple]:
        """The first n rows of the window."""
        todo = self.window[:n]
        if not self.serpentine:
            yield from zip((y for y, *_ in todo), (images for _, images, *_ in todo), self._front(n), strict=True)
            self.window = self.window[n:]
            return
        for y, images, *_ in todo:
            yield y, images, self._row(y % 2 == 1)
            self.window.pop(0)

    def _chosen(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Working values (n x 3) as they are matched, and the places of their nearest colours."""
        v = v.astype(np.float64)
        if not self.as_bytes:
            return v, self.nearest(v)
        whole = np.clip(np.floor(v + 0.5), 0, 255)
        return v if self.unclamped else whole, self.nearest(byte_vectors(whole, self.space))

    def _front(self, n: int) -> list[np.ndarray]:
        """Indices of the first n rows by a wavefront; leaves the errors in the rows below."""
        _, images, first, *_ = self.window[0]
        m, width, pad = len(images), first.shape[1], self.reach
        stride, rows = width + 2 * pad, len(self.window) + self.depth
        work = np.zeros((m, rows * stride, 3), np.float32)
        clear, share, idx = np.ones((m, rows * stride), bool), np.zeros((m, rows * stride)), np.full((m, rows * stride), self.masked, np.int32)
        for j, (_, _, w, c, s) in enumerate(self.window):
            own = slice(j * stride + pad, j * stride + pad + width)
            work[:, own], clear[:, own], share[:, own] = w, c, s
        step = stride - self.lag
        taps = [(dy * stride + dx, weight) for dx, dy, weight in sorted(self.kernel, key=lambda tap: -tap[1])]  # rows above come first
        for t in range(width + self.lag * (n - 1)):
            top, bottom = max(0, -(-(t - width + 1) // self.lag)), min(n - 1, t // self.lag)
            start, count = pad + t + top * step, bottom - top + 1
            at = lambda shift, start=start, count=count: slice(start + shift, start + shift + (count - 1) * step + 1, step)
            seen = ~clear[:, at(0)]
            v, k = self._chosen(work[:, at(0)].reshape(-1, 3))
            idx[:, at(0)] = np.where(seen, self.ords[k].reshape(m, count), self.masked)
            error = np.where(seen[..., None], (v - self.targets[k]).reshape(m, count, 3), 0.0)
            here = share[:, at(0)]
            for shift, weight in taps:
                work[:, at(shift)] += error * (weight * here)[..., None]
        for j in range(n, len(self.window)):
            self.window[j][2][:] = work[:, j * stride + pad : j * stride + pad + width]
        return [idx[:, j * stride + pad : j * stride + pad + width] for j in range(n)]

    def _row(self, reverse: bool) -> np.ndarray:
        """Indices of the first row of the window; adds its errors to the rows below."""
        _, images, work, clear, share = self.window[0]
        if reverse:
            work, clear, share = work[:, ::-1], clear[:, ::-1], share[:, ::-1]
        idx, error = (self._by_numbers if len(images) < FEW else self._in_lockstep)(work, clear, share)
        width = work.shape[1]
        for dx, dy, weight in self.below:
            if dy < len(self.window):
                row = self.window[dy][2][:, ::-1] if reverse else self.window[dy][2]
                source, to = slice(max(0, -dx), width - max(0, dx)), slice(max(0, dx), width + min(0, dx))
                row[:, to] += error[:, source] * (weight * share[:, source])[..., None]
        return idx[:, ::-1] if reverse else idx

    def _in_lockstep(self, work: np.ndarray, clear: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and errors of a row from left to right, the same pixel of all images at once."""
        m, width, _ = work.shape
        work, idx, error = work.copy(), np.full((m, width), self.masked, np.int32), np.zeros((m, width, 3))
        for x in range(width):
            seen = ~clear[:, x]
            v, k = self._chosen(work[:, x])
            idx[seen, x] = self.ords[k[seen]]
            error[:, x] = np.where(seen[:, None], v - self.targets[k], 0.0)
            for dx, weight in self.ahead:
                if x + dx < width:
                    work[:, x + dx] += error[:, x] * (weight * share[:, x])[:, None]
        return idx, error

    def _by_numbers(self, work: np.ndarray, clear: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, image by image, without arrays of one element."""
        m, width, _ = work.shape
        idx, error = np.full((m, width), self.masked, np.int32), np.zeros((m, width, 3))
        targets, ords, known = self.targets.tolist(), self.ords.tolist(), self.remembered
        for i in range(m):
            a, b, c = (array("f", [*work[i, :, k].tolist(), *[0.0] * self.reach]) for k in range(3))  # rounds what is stored to float32
            found, out = [self.masked] * width, [(0.0, 0.0, 0.0)] * width
            for x, (hidden, part) in enumerate(zip(clear[i].tolist(), share[i].tolist(), strict=True)):
                if hidden:
                    continue
                u, v, w = a[x], b[x], c[x]
                if self.as_bytes:
                    u, v, w = (min(255, max(0, math.floor(z + 0.5))) for z in (u, v, w))
                    cell = (u >> 2) << 12 | (v >> 2) << 6 | w >> 2
                    if cell not in known:
                        known[cell] = self._chosen(_CELL + (u & 252, v & 252, w & 252))[1].astype(np.uint8).tobytes()
                    k = known[cell][(u & 3) << 4 | (v & 3) << 2 | w & 3]
                else:
                    k = int(color.squared_distance((u, v, w), self.points, self.space).argmin())
                if self.unclamped:
                    u, v, w = a[x], b[x], c[x]
                p, q, r = targets[k]
                found[x] = ords[k]
                out[x] = u, v, w = u - p, v - q, w - r
                for dx, weight in self.ahead:
                    weight *= part
                    a[x + dx] += u * weight
                    b[x + dx] += v * weight
                    c[x + dx] += w * weight
            idx[i], error[i] = found, out
        return idx, error


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(y, image ids, work, clear, mask) of the same row of all images of a bundle, from rows sorted by bundle and y."""
    key, held = None, []

    def stacked():
        parts = [np.stack([np.asarray(getattr(r, c)) for r in held]) for c in ("v0", "v1", "v2", "clear", "mask")]
        return key[-1], [r.image_id for r in held], np.stack(parts[:3], axis=-1).astype(np.float32), parts[3].astype(bool), parts[4].astype(float)

    for frame in frames:
        for r in frame.itertuples(index=False):
            if (r.width, r.height, r.bundle, r.y) != key:
                if held:
                    yield stacked()
                key, held = (r.width, r.height, r.bundle, r.y), []
            if len(r.v0) != r.width:
                raise ValueError(f"row {r.y} of image {r.image_id} has {len(r.v0)} of {r.width} pixels")
            held.append(r)
    if held:
        yield stacked()


def quantize(px: DataFrame, palette: Sequence[Swatch], s: Settings, unclamped: bool = False) -> DataFrame:
    """image_id, y, x, idx by the kernel named in the settings; a strength of 0 is direct quantizing.

    unclamped: errors in bytes are measured from the working values as they are, as previews do.
    """
    if s.strength <= 0 or not any(p.visible for p in palette):
        return dither.quantize(px, palette, s)
    source = dither.adaptive_mask(px, palette, s) if s.placement == "adaptive" else px.withColumn("mask", F.lit(1.0))
    seen = composited(tuple(F.col(c) for c in "rgb"), F.col("a"), s.alpha_mode, s.matte)
    dithered = color.SPACES[s.color_space](seen) if s.in_vectors else tuple(c.cast("double") for c in seen)
    pixel = F.struct("x", *(v.alias(f"v{k}") for k, v in enumerate(dithered)), is_transparent(F.col("a"), s.alpha_mode, s.alpha_threshold).alias("clear"), "mask")
    packed = source.select("image_id", "y", pixel.alias("p")).groupBy("image_id", "y").agg(F.array_sort(F.collect_list("p")).alias("p"))  # an image row
    held = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("height"), F.count("*").alias("n"))
    whole = F.when(F.col("n") == F.col("w").cast("long") * F.col("height"), F.col("w")).otherwise(F.raise_error(F.concat(F.lit("image with missing or repeated pixels: "), F.col("image_id").cast("string"))).cast("int"))
    sizes = held.select("image_id", whole.alias("width"), "height")
    bundles = sizes.groupBy("width", "height").agg(F.ceil(F.count("*") / BUNDLE).alias("bundles"))
    placed = sizes.join(bundles, ["width", "height"]).select("image_id", "width", "height", F.pmod(F.xxhash64("image_id"), F.col("bundles")).alias("bundle"))
    rows = packed.join(placed, "image_id").select("image_id", "y", "width", "height", "bundle", *(F.col(f"p.{c}").alias(c) for c in ("v0", "v1", "v2", "clear", "mask")))
    keys = ["width", "height", "bundle"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "y", "image_id")
    vectors = np.array(match.palette_vectors(px.sparkSession, palette, s.color_space))
    visible = [p for p in palette if p.visible]
    targets = vectors if s.in_vectors else np.array([p.rgb for p in visible], float)
    settings = {"kernel": KERNELS[s.dither], "vectors": vectors, "targets": targets, "ords": np.array([p.ord for p in visible], np.int32), "space": s.color_space, "as_bytes": not s.in_vectors, "serpentine": s.serpentine, "strength": s.strength / 100, "masked": dither.masked_index(palette), "unclamped": unclamped}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scan(**settings)
        done = (out for row in _rows(frames) for out in scan.add(*row))
        for y, images, idx in _then(done, scan.finish):
            yield pd.DataFrame({"image_id": images, "y": y, "idx": list(idx)})

    out = dealt.mapInPandas(run, "image_id long, y int, idx array<int>")
    return out.select("image_id", "y", F.posexplode("idx").alias("x", "idx"))


def _then(items: Iterator, last: Callable[[], Iterator]) -> Iterator:
    yield from items
    yield from last()
