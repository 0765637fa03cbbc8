"""Image files as tables: admission, decoding, synthetic images, indexed PNG export."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom import schemas

HEADER_BYTES = 1 << 20


def magic_type(content: Column) -> Column:
    """MIME type by the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def _number(content: Column, at: int, n: int, little: bool = False) -> Column:
    parts = [F.hex(F.substring(content, at + i, 1)) for i in (range(n - 1, -1, -1) if little else range(n))]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def png_size(content: Column) -> tuple[Column, Column]:
    return _number(content, 17, 4), _number(content, 21, 4)


def gif_size(content: Column) -> tuple[Column, Column]:
    return _number(content, 7, 2, little=True), _number(content, 9, 2, little=True)


def jpeg_or_webp_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from a JPEG's frame header or a WebP's first chunk; None if there is none."""
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(head):
            if head[at] != 0xFF:
                return None
            marker = head[at + 1]
            if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 0x01:
                at += 1 if marker == 0xFF else 2
                continue
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", head[at + 5 : at + 9])
                return width, height
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
        return None
    kind = head[12:16]
    if kind == b"VP8X" and len(head) >= 30:
        return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
    if kind == b"VP8L" and len(head) >= 25 and head[20] == 0x2F:
        bits = int.from_bytes(head[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and len(head) >= 30 and head[23:26] == b"\x9d\x01\x2a":
        return int.from_bytes(head[26:28], "little") & 0x3FFF, int.from_bytes(head[28:30], "little") & 0x3FFF
    return None


def admit(files: DataFrame) -> DataFrame:
    """path, mime, bytes, width, height, reason (null if admitted) of a ``binaryFile`` table, judged before decoding."""
    mime = magic_type(F.col("content"))
    known = files.select("path", F.col("length").alias("bytes"), mime.alias("mime"), F.substring("content", 1, HEADER_BYTES).alias("head"))
    png, gif = png_size(F.col("head")), gif_size(F.col("head"))
    direct = known.where(F.coalesce(F.col("mime"), F.lit("")).isin("image/png", "image/gif", ""))
    sized = direct.select("path", "mime", "bytes", *(F.when(F.col("mime") == "image/png", p).when(F.col("mime") == "image/gif", g).alias(n) for n, p, g in zip(("width", "height"), png, gif, strict=True)))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = [jpeg_or_webp_size(bytes(h)) or (None, None) for h in frame["head"]]
            out = frame[["path", "mime", "bytes"]].copy()
            out["width"], out["height"] = (pd.array([s[k] for s in sizes], "Int64") for k in (0, 1))
            yield out

    walked = known.where(F.col("mime").isin("image/jpeg", "image/webp")).mapInPandas(walk, "path string, mime string, bytes long, width long, height long")
    return judged(sized.unionByName(walked))


def judged(files: DataFrame) -> DataFrame:
    """Adds reason, null if a file (mime, bytes, width, height) is admitted."""
    reason = (
        F.when(F.col("mime").isNull(), "unsupported type")
        .when(F.col("bytes") > schemas.MAX_FILE_BYTES, "file too large")
        .when(F.col("width").isNull() | F.col("height").isNull() | (F.col("width") < 1) | (F.col("height") < 1), "unreadable size")
        .when((F.col("width") > schemas.MAX_SOURCE_SIDE) | (F.col("height") > schemas.MAX_SOURCE_SIDE), "side too long")
        .when(F.col("width") * F.col("height") > schemas.MAX_PIXELS, "too many pixels")
        .when(F.col("mime") == "image/webp", "no decoder")
    )
    return files.withColumn("reason", reason)


def sources(files: DataFrame) -> DataFrame:
    """image_id, name, mime, width, height, updated_at of a ``binaryFile`` table: what a job's identity takes from its file.

    image_id is that of :func:`read_images` for the same path.
    """
    origin = F.regexp_replace("path", "^file:/+", "file:///")
    changed = files.select("path", F.col("modificationTime").alias("updated_at"))
    named = admit(files).join(changed, "path")
    return named.select(F.xxhash64(origin).alias("image_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "mime", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "updated_at")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id (hash of the path), path, width, height, channels, data (BGR or BGRA rows) of readable images."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)
    return image_rows(found)


def image_rows(found: DataFrame) -> DataFrame:
    return found.select(F.xxhash64("image.origin").alias("image_id"), F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def explode_pixels(images: DataFrame, band: int = 64) -> DataFrame:
    """One row per pixel, in batches of ``band`` image rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                for top in range(0, r.height, band):
                    part = pixels[top : top + band].astype(np.int32)
                    y, x = np.mgrid[top : top + len(part), 0 : r.width]
                    b, g, red = (part[..., min(k, r.channels - 1)] for k in range(3))
                    a = part[..., 3] if r.channels == 4 else np.full(b.shape, 255)
                    yield pd.DataFrame({"image_id": r.image_id, "y": y.ravel(), "x": x.ravel(), "r": red.ravel(), "g": g.ravel(), "b": b.ravel(), "a": a.ravel()})

    return images.select("image_id", "width", "height", "channels", "data").mapInPandas(run, schemas.PIXELS)


def pack_rows(indexed: DataFrame) -> DataFrame:
    """image_id, y, data: the indices of each image row as bytes, for Parquet; ``unpack_rows`` reverses it."""
    rows = indexed.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "idx"))).alias("p"))
    return rows.select("image_id", "y", F.unhex(F.concat_ws("", F.transform("p", lambda e: F.lpad(F.hex(e["idx"].cast("long")), 2, "0")))).alias("data"))


def unpack_rows(rows: DataFrame) -> DataFrame:
    digits = F.hex("data")
    values = F.transform(F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return rows.select("image_id", "y", F.posexplode(values).alias("x", "idx"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(width: int, rows: list[bytes], palette: list[tuple[int, int, int, bool]]) -> bytes:
    """An 8-bit indexed PNG; palette entries are (r, g, b, transparent).  Filter 0, stored (not compressed) data."""
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 3, 0, 0, 0)
    colors = b"".join(bytes(p[:3]) for p in palette)
    clear = bytes(0 if p[3] else 255 for p in palette)
    chunks = [_chunk(b"IHDR", header), _chunk(b"PLTE", colors), _chunk(b"tRNS", clear), _chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows), 0)), _chunk(b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(chunks)


def export_png(rows: DataFrame, palette: list[tuple[int, int, int, bool]]) -> DataFrame:
    """image_id, content of packed rows (image_id, y, data).  A file is one image and is put together by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, parts = None, []
        for frame in frames:
            for image, data in zip(frame["image_id"], frame["data"], strict=True):
                if image != current and parts:
                    yield pd.DataFrame({"image_id": [current], "content": [encode_png(len(parts[0]), parts, palette)]})
                    parts = []
                current = image
                parts.append(bytes(data))
        if parts:
            yield pd.DataFrame({"image_id": [current], "content": [encode_png(len(parts[0]), parts, palette)]})

    return rows.repartition("image_id").sortWithinPartitions("image_id", "y").select("image_id", "data").mapInPandas(run, "image_id long, content binary")


def _grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    cells = spark.range(width * height)
    return cells.select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def name_seed(name: str) -> int:
    """A 32-bit seed of a name (FNV-1a)."""
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h


def _byte(v: Column) -> Column:
    """Low 8 bits of the truncated value."""
    return F.pmod(v.cast("long"), F.lit(256)).cast("int")


def _image(cells: DataFrame, image_id: int, r: Column, g: Column, b: Column, a: Column) -> DataFrame:
    return cells.select(F.lit(image_id).cast("long").alias("image_id"), "y", "x", *(c.cast("int").alias(n) for n, c in zip("rgba", (r, g, b, a), strict=True)))


def synth_gradient(spark: SparkSession, image_id: int, width: int, height: int) -> DataFrame:
    """Red grows to the right, green downwards, blue towards the diagonal; opaque."""
    across, down = F.col("x") / float(max(1, width - 1)), F.col("y") / float(max(1, height - 1))
    level = lambda v: F.floor(v * 255 + 0.5)
    return _image(_grid(spark, width, height), image_id, level(across), level(down), level(F.lit(1.0) - F.abs(across - down)), F.lit(255))


def synth_alpha(spark: SparkSession, image_id: int, width: int, height: int) -> DataFrame:
    """A pattern behind rings of alpha 0, 96 and 255 around the middle."""
    x, y = F.col("x"), F.col("y")
    ring = F.hypot(x - width / 2, y - height / 2) / max(width, height)
    return _image(_grid(spark, width, height), image_id, _byte(x * 9 + y * 5), _byte(x * 3 + y * 11), _byte(x * 17 + y * 7), F.when(ring < 0.18, 0).when(ring < 0.32, 96).otherwise(255))


def synth_photo(spark: SparkSession, image_id: int, width: int, height: int, name: str = "photoish") -> DataFrame:
    """Overlaid slopes and waves, seeded by a name; every 31st diagonal is half transparent."""
    x, y, seed = F.col("x").cast("long"), F.col("y").cast("long"), name_seed(name)
    wave = F.sin((x + seed) * 0.017) + F.cos((y - seed) * 0.021)
    r, g, b = x * 13 + y * 3 + seed + wave * 32, x * 5 + y * 17 + seed * 3 - wave * 24, x * y + seed * 7 + wave * 18
    return _image(_grid(spark, width, height), image_id, _byte(r), _byte(g), _byte(b), F.when((x + y + seed) % 31 == 0, 96).otherwise(255))


# Greys of the ramp by place.
RAMP = ((0.0, 0), (0.2, 32), (0.5, 119), (0.8, 221), (1.0, 255))


def synth_ramp(spark: SparkSession, image_id: int, size: int) -> DataFrame:
    """A grey ramp from the lower left to the upper right corner, linear between five stops."""
    extent = float(max(1, size - 1))
    at = (F.col("x") / extent + (F.lit(1.0) - F.col("y") / extent)) / 2
    grey = F.lit(float(RAMP[-1][1]))
    for (p, v), (q, w) in reversed(list(zip(RAMP, RAMP[1:], strict=False))):
        grey = F.when(at <= q, (at - p) / (q - p) * (w - v) + v).otherwise(grey)
    level = F.floor(grey + 0.5)
    return _image(_grid(spark, size, size), image_id, level, level, level, F.lit(255))


#: Images of the standing corpus: maker, width, height.
CORPUS = {"standard": (("gradient", 1536, 1024), ("alpha", 1024, 1024), ("photo", 1920, 1080)), "large": (("gradient", 1536, 1024), ("alpha", 1024, 1024), ("photo", 1920, 1080), ("pressure", 4096, 4096))}


def synth_corpus(spark: SparkSession, profile: str = "standard") -> DataFrame:
    make = {"gradient": synth_gradient, "alpha": synth_alpha, "photo": synth_photo, "pressure": lambda *a: synth_photo(*a, name="memory-pressure")}
    out = None
    for i, (kind, width, height) in enumerate(CORPUS[profile]):
        image = make[kind](spark, i, width, height)
        out = image if out is None else out.unionByName(image)
    return out
