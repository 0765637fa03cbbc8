"""Nearest palette colour, without a shuffle.

A palette of at most 256 colours is a literal: the distances to all its visible colours form an array, and the answer
is the position of the array's first minimum, so ties go to the lowest ordinal and transparent never wins.  The whole
match is a column expression in generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.color import DISTANCES, SPACES, Triple
from pixelloom.schemas import EPSILON, MAX_COLORS
from pixelloom.sources.palettes import Swatch

RGB = ("r", "g", "b")


def _literals(values) -> tuple[Column, ...]:
    return tuple(F.lit(float(v)) for v in values)


def distances(v: Triple, vectors: Sequence[Sequence[float]], space: str) -> Column:
    return F.array(*(DISTANCES[space](v, _literals(q)) for q in vectors))


def palette_vectors(spark, palette: Sequence[Swatch], space: str) -> list[list[float]]:
    """Vectors of the visible colours in order, worked out by the same expressions as those of pixels."""
    rows = [(i, *s.rgb) for i, s in enumerate(p for p in palette if p.visible)]
    vectors = spark.createDataFrame(rows, "i int, r int, g int, b int")
    got = vectors.select("i", *(c.alias(f"v{k}") for k, c in enumerate(SPACES[space](tuple(F.col(c) for c in RGB))))).collect()
    return [[r["v0"], r["v1"], r["v2"]] for r in sorted(got, key=lambda r: r["i"])]


def axis_ranges(vectors: Sequence[Sequence[float]]) -> list[float]:
    """Largest minus smallest value on each axis, at least the machine epsilon."""
    return [max(max(v[k] for v in vectors) - min(v[k] for v in vectors), EPSILON) for k in range(3)]


def first_minimum(array: Column, ords: Sequence[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, ords)), F.array_position(array, F.array_min(array)).cast("int"))


def limit_methods(spark: SparkSession) -> None:
    """Leave generated methods beyond 8000 bytes of bytecode, which HotSpot would only interpret, to code that Spark splits.

    The distances to a whole palette make such a method; with Spark's default limit of 65535 matching is three times as
    slow.  A limit that the session has set itself is left alone.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, "65535") == "65535":
        spark.conf.set(key, "8000")


def nearest_vector(px: DataFrame, palette: Sequence[Swatch], space: str, columns: Sequence[str] = ("v0", "v1", "v2"), out: str = "idx") -> DataFrame:
    """Adds the palette ordinal that is nearest to vectors already in the space."""
    limit_methods(px.sparkSession)
    vectors = palette_vectors(px.sparkSession, palette, space)
    ords = [s.ord for s in palette if s.visible]
    with_array = px.withColumn("_d", distances(tuple(F.col(c) for c in columns), vectors, space))
    return with_array.withColumn(out, first_minimum(F.col("_d"), ords).cast("int")).drop("_d")


def nearest(px: DataFrame, palette: Sequence[Swatch], space: str = "srgb", columns: Sequence[str] = RGB, out: str = "idx") -> DataFrame:
    """Adds the palette ordinal that is nearest to byte colours."""
    named = px.select("*", *(v.alias(f"_v{k}") for k, v in enumerate(SPACES[space](tuple(F.col(c) for c in columns)))))
    return nearest_vector(named, palette, space, ("_v0", "_v1", "_v2"), out).drop("_v0", "_v1", "_v2")


def nearest_distinct(px: DataFrame, palette: Sequence[Swatch], space: str = "srgb", columns: Sequence[str] = RGB, out: str = "idx") -> DataFrame:
    """The same, worked out once for each distinct colour: for many repeated colours and costly spaces.

    The answers are a table of 256 pages (by red) of 65 536 bytes, 16 MB whatever the images, which tasks carry: pixels
    are not shuffled, and a frequent colour is no hot key.
    """
    r, g, b = columns
    found = nearest(px.select(*columns).where(F.col(r).isNotNull()).distinct(), palette, space, columns, "_idx").select(F.col(r).alias("_r"), (F.col(g) * 256 + F.col(b)).alias("_at"), "_idx")

    def page(colors: pa.Table) -> pa.Table:
        values = np.zeros(65_536, np.int8)
        values[colors["_at"].to_numpy()] = colors["_idx"].to_numpy() - 128
        return pa.table({"_r": colors["_r"][:1], "_page": pa.array([values], pa.list_(pa.int8()))})

    pages = found.groupBy("_r").applyInArrow(page, "_r int, _page array<tinyint>")
    joined = px.join(F.broadcast(pages), px[r] == pages["_r"])
    return joined.withColumn(out, (F.element_at("_page", F.col(g) * 256 + F.col(b) + 1) + 128).cast("int")).drop("_r", "_page")


def nearest_by_palette(px: DataFrame, palettes: DataFrame, out: str = "idx") -> DataFrame:
    """Nearest colour (squared sRGB) of each row's own palette ``palette_name``; palettes (palette_name, ord, r, g, b).

    Of a palette only its first 256 colours count.  A row whose palette is missing or has no visible colour stays, with
    a null index.
    """
    packed = palettes.where((F.col("ord") < MAX_COLORS) & F.col("r").isNotNull()).groupBy("palette_name").agg(F.array_sort(F.collect_list(F.struct("ord", "r", "g", "b"))).alias("_colors"))
    here = tuple(F.col(c).cast("long") for c in RGB)

    def far(c: Column) -> Column:
        d = [a - c[n] for a, n in zip(here, RGB, strict=True)]
        return F.struct((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d"), c["ord"].alias("ord"))

    return px.join(packed, "palette_name", "left").withColumn(out, F.array_min(F.transform("_colors", far))["ord"]).drop("_colors")


def render(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """Indices back to RGBA: transparent is (0, 0, 0, 0), every other colour opaque.  A palette of more than 256 rows is an error."""
    if palette.limit(MAX_COLORS + 1).count() > MAX_COLORS:
        raise ValueError(f"a palette has at most {MAX_COLORS} colours")
    colors = palette.select(F.col("ord").alias("idx"), "kind", "r", "g", "b")
    clear = F.col("kind") == "transparent"
    joined = indexed.join(F.broadcast(colors), "idx")
    return joined.select(*indexed.columns, *(F.when(clear, 0).otherwise(F.col(c)).alias(c) for c in RGB), F.when(clear, 0).otherwise(255).alias("a"))
