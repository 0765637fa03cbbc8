"""Names, tags, hex colours, identities and report texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.schemas import MAX_NAME_CHARS, MAX_TAG_CHARS, MAX_TAGS


def clean_name(name: Column, default: str) -> Column:
    """Trimmed and cut; the default when nothing is left."""
    return F.coalesce(F.nullif(F.substring(F.trim(name), 1, MAX_NAME_CHARS), F.lit("")), F.lit(default))


def clean_tags(tags: Column) -> Column:
    """Trimmed, cut, distinct tags in order, the first MAX_TAGS of them; null if none is left."""
    cut = F.transform(tags, lambda t: F.substring(F.trim(t), 1, MAX_TAG_CHARS))
    kept = F.slice(F.array_distinct(F.filter(cut, lambda t: t.isNotNull() & (t != ""))), 1, MAX_TAGS)
    return F.when(F.size(kept) > 0, kept)


def normalize_hex(text: Column) -> Column:
    """``#RRGGBB`` in capitals, from ``#RGB`` or ``#RRGGBB``; null if it is neither."""
    bare = F.trim(text)
    wide = F.when(bare.rlike("^#[0-9a-fA-F]{3}$"), F.regexp_replace(bare, "^#(.)(.)(.)$", "#$1$1$2$2$3$3")).otherwise(bare)
    return F.when(wide.rlike("^#[0-9a-fA-F]{6}$"), F.upper(wide))


def hex_channel(key: Column, channel: int) -> Column:
    """Red, green or blue (0, 1, 2) of ``#RRGGBB``."""
    return F.conv(F.substring(key, 2 + 2 * channel, 2), 16, 10).cast("int")


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)))


def export_name(name: Column, suffix: Column, width: Column, height: Column) -> Column:
    """``<safe name>-<suffix>-<width>x<height>.png``."""
    bare = F.trim(F.regexp_replace(name, r"\.[^.]+$", ""))
    safe = F.regexp_replace(F.regexp_replace(bare, r"[^a-zA-Z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("image")), F.lit("-"), suffix, F.lit("-"), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(".png"))


def format_bytes(n: Column) -> Column:
    """Bytes below 1024, else KiB, MiB, GiB or TiB with a decimal below ten; halves go up."""
    text = F.format_string("%.1f TiB", n / 1024.0**4)
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        size = n / 1024.0**power
        text = F.when(size < 1024, F.when(size < 10, F.format_string(f"%.1f {unit}", size)).otherwise(F.format_string(f"%.0f {unit}", size))).otherwise(text)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(text)


def format_ms(ms: Column) -> Column:
    """Two decimals below 10, one below 100, none from there."""
    return F.when(ms.isNull() | (ms == 0), "0ms").when(ms < 10, F.format_string("%.2fms", ms)).when(ms < 100, F.format_string("%.1fms", ms)).otherwise(F.format_string("%dms", F.floor(ms + 0.5)))


def format_stage_ms(ms: Column) -> Column:
    """The study's form: one decimal below 100, none from there."""
    return F.when(ms >= 100, F.format_string("%dms", F.floor(ms + 0.5))).otherwise(F.format_string("%.1fms", ms))


def _thousands(n: Column, unit: str, small: Column) -> Column:
    millions = F.floor(n / 1e6 * 10 + 0.5) / 10
    return F.when(n >= 1_000_000, F.format_string(f"%.1f{unit}", millions)).when(n >= 1_000, F.format_string("%dK", F.floor(n / 1e3 + 0.5))).otherwise(small)


def format_count(n: Column) -> Column:
    """Whole numbers below a thousand, then thousands, then millions with a decimal."""
    return _thousands(n, "M", F.floor(n + 0.5).cast("string"))


def format_pixels(n: Column) -> Column:
    return _thousands(n, "MP", n.cast("string"))


def format_percent(share: Column) -> Column:
    """``0%`` for nothing, two decimals below a tenth, one from there."""
    return F.when(share == 0, "0%").when(share >= 0.1, F.format_string("%.1f%%", share * 100.0)).otherwise(F.format_string("%.2f%%", share * 100.0))


def identity(fields: dict[str, Column]) -> Column:
    """SHA-256 of the JSON of the fields, keys sorted: equal settings have equal identities whatever their order."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)
