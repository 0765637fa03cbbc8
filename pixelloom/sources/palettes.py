"""Palettes: the built-in one, JSON import and export, and the small in-memory form that operators embed as literals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom import schemas
from pixelloom.functions.text import clean_name, clean_tags, normalize_hex

DEFAULT_NAME = "Default"
# The built-in palette in order; the first 31 are free, the last is transparent, the rest premium.
DEFAULT_COLORS = (
    ("Black", "#000000"), ("Dark Gray", "#3C3C3C"), ("Gray", "#787878"), ("Light Gray", "#D2D2D2"), ("White", "#FFFFFF"), ("Deep Red", "#600018"), ("Red", "#ED1C24"), ("Orange", "#FF7F27"),
    ("Gold", "#F6AA09"), ("Yellow", "#F9DD3B"), ("Pale Yellow", "#FFFABC"), ("Green", "#0EB968"), ("Light Green", "#13E67B"), ("Mint", "#87FF5E"), ("Deep Teal", "#0C816E"), ("Teal", "#10AE82"),
    ("Cyan", "#13E1BE"), ("Aqua", "#60F7F2"), ("Blue", "#28509E"), ("Light Blue", "#4093E4"), ("Indigo", "#6B50F6"), ("Periwinkle", "#99B1FB"), ("Purple", "#780C99"), ("Magenta", "#AA38B9"),
    ("Lavender", "#E09FF9"), ("Hot Pink", "#CB007A"), ("Rose", "#EC1F80"), ("Pink", "#F38DA9"), ("Brown", "#684634"), ("Tan", "#95682A"), ("Peach", "#F8B277"), ("Silver", "#AAAAAA"),
    ("Crimson", "#A50E1E"), ("Coral", "#FA8072"), ("Burnt Orange", "#E45C1A"), ("Olive", "#9C8431"), ("Mustard", "#C5AD31"), ("Sand", "#E8D45F"), ("Moss", "#4A6B3A"), ("Leaf", "#5A944A"),
    ("Pistachio", "#84C573"), ("Ocean", "#0F799F"), ("Pale Aqua", "#BBFAF2"), ("Sky Blue", "#7DC7FF"), ("Violet", "#4D31B8"), ("Slate Purple", "#4A4284"), ("Soft Purple", "#7A71C4"), ("Pale Violet", "#B5AEF1"),
    ("Brick", "#9B5249"), ("Dusty Rose", "#D18078"), ("Light Coral", "#FAB6A4"), ("Caramel", "#DBA463"), ("Umber", "#7B6352"), ("Taupe", "#9C846B"), ("Beige", "#D6B594"), ("Terracotta", "#D18051"),
    ("Apricot", "#FFC5A5"), ("Army", "#6D643F"), ("Khaki", "#948C6B"), ("Cream", "#CDC59E"), ("Charcoal Blue", "#333941"), ("Steel", "#6D758D"), ("Pale Steel", "#B3B9D1"), ("Transparent", "transparent"),
)
FREE_COLORS = 31


@dataclass(frozen=True)
class Swatch:
    """One palette entry; rgb is None for the transparent one."""

    ord: int
    key: str
    kind: str
    rgb: tuple[int, int, int] | None

    @property
    def visible(self) -> bool:
        return self.rgb is not None and self.kind != "transparent"


def default_rows() -> list[tuple]:
    rows = []
    for i, (name, key) in enumerate(DEFAULT_COLORS):
        kind = "transparent" if key == "transparent" else "free" if i < FREE_COLORS else "premium"
        rgb = (None,) * 3 if kind == "transparent" else tuple(int(key[k : k + 2], 16) for k in (1, 3, 5))
        rows.append((DEFAULT_NAME, i, key, name, kind, *rgb, None))
    return rows


def default_palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_rows(), schemas.PALETTE)


def swatches(palette: DataFrame) -> list[Swatch]:
    """A palette of at most MAX_COLORS rows as literals, by ord; more rows are an error."""
    rows = palette.orderBy("ord").select("ord", "key", "kind", "r", "g", "b").limit(schemas.MAX_COLORS + 1).collect()
    if len(rows) > schemas.MAX_COLORS:
        raise ValueError(f"a palette has at most {schemas.MAX_COLORS} colours; truncate it first")
    return [Swatch(r["ord"], r["key"], r["kind"], None if r["r"] is None else (r["r"], r["g"], r["b"])) for r in rows]


def default_swatches() -> list[Swatch]:
    return [Swatch(o, key, kind, None if r is None else (r, g, b)) for _, o, key, _, kind, r, g, b, _ in default_rows()]


IMPORT_SCHEMA = "name string, colors array<struct<name:string,key:string,hex:string,kind:string,tags:array<string>>>"


def parse_palettes(documents: DataFrame) -> DataFrame:
    """Palette rows of imported documents (name, colors); ``error`` tells why a row or its palette is not accepted.

    Names are trimmed and cut, hex values normalised, visible kinds become custom, and a key that repeats in a palette
    is an error, as is a palette name that repeats in the import or a palette without colours.
    """
    named = documents.select(clean_name(F.col("name"), "Imported palette").alias("palette_name"), "colors")
    rows = named.select("palette_name", F.posexplode_outer("colors").alias("ord", "c"))
    hexed = normalize_hex(F.coalesce(F.col("c.hex"), F.col("c.key")))
    transparent = (F.col("c.kind") == "transparent") | (F.col("c.key") == "transparent")
    parsed = rows.select(
        "palette_name",
        "ord",
        F.when(transparent, "transparent").otherwise(hexed).alias("key"),
        clean_name(F.col("c.name"), "Color").alias("name"),
        F.when(transparent, "transparent").otherwise("custom").alias("kind"),
        *(F.when(~F.coalesce(transparent, F.lit(False)), F.conv(F.substring(hexed, at, 2), 16, 10).cast("int")).alias(c) for c, at in zip("rgb", (2, 4, 6), strict=True)),
        clean_tags(F.col("c.tags")).alias("tags"),
    )
    names = named.groupBy("palette_name").agg(F.count("*").alias("_named"))
    keys = parsed.groupBy("palette_name", "key").agg(F.count("*").alias("_keyed"))
    joined = parsed.join(names, "palette_name").join(keys, (keys["palette_name"] == parsed["palette_name"]) & keys["key"].eqNullSafe(parsed["key"])).select(parsed["*"], "_named", "_keyed")
    error = F.when(F.col("ord").isNull(), "no colors").when(F.col("palette_name") == DEFAULT_NAME, "reserved name").when(F.col("_named") > 1, "duplicate palette").when(F.col("key").isNull(), "invalid color").when(F.col("_keyed") > 1, "duplicate color")
    return joined.select(*parsed.columns, error.alias("error"))


def read_palettes(spark: SparkSession, path: str) -> DataFrame:
    """Palettes of JSON files, each one object or an array of objects."""
    return parse_palettes(spark.read.schema(IMPORT_SCHEMA).option("multiLine", True).json(path))


def export_palettes(palettes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """name and colors of custom palettes, all or the named ones, colours in order; write it with ``.write.json``."""
    own = palettes.where(F.col("palette_name") != DEFAULT_NAME)
    if names is not None:
        own = own.where(F.col("palette_name").isin(names))
    entry = F.struct("ord", "name", "key", "kind", "tags")
    packed = own.groupBy(F.col("palette_name").alias("name")).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    return packed.select("name", F.transform("c", lambda e: F.struct(e["name"].alias("name"), e["key"].alias("key"), e["kind"].alias("kind"), e["tags"].alias("tags"))).alias("colors"))


def with_transparent(custom: DataFrame) -> DataFrame:
    """Every custom palette gets a transparent entry after its last colour, unless it has one."""
    own = custom.where(F.col("kind") != "transparent")
    last = own.groupBy("palette_name").agg((F.max("ord") + 1).alias("ord"))
    none: Column = F.lit(None)
    swatch = last.select("palette_name", "ord", F.lit("transparent").alias("key"), F.lit("Transparent").alias("name"), F.lit("transparent").alias("kind"), *(none.cast("int").alias(c) for c in "rgb"), none.cast("array<string>").alias("tags"))
    return own.unionByName(swatch)


def all_palettes(custom: DataFrame) -> DataFrame:
    """The built-in palette, then the custom ones."""
    return default_palette(custom.sparkSession).unionByName(with_transparent(custom))
