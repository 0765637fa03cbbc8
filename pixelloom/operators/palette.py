"""Palette tables: filters, enabled state, validation, set operations and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pixelloom import schemas
from pixelloom.functions.text import clean_name, normalize_hex
from pixelloom.sources.palettes import DEFAULT_NAME

VISIBLE = "kind <> 'transparent' and r is not null"


def _by_palette() -> WindowSpec:
    return Window.partitionBy("palette_name")


def truncate(palette: DataFrame) -> DataFrame:
    """The first 256 colours of every palette, and whether any was cut."""
    cut = palette.withColumn("truncated", F.max("ord").over(_by_palette()) >= schemas.MAX_COLORS)
    return cut.where(F.col("ord") < schemas.MAX_COLORS)


def visible(palette: DataFrame) -> DataFrame:
    return palette.where(VISIBLE)


def with_state(palette: DataFrame, enabled: DataFrame) -> DataFrame:
    """Adds ``enabled``: the state (palette_name, key, enabled) of the colour, or of its key alone, else true."""
    own = enabled.where("palette_name is not null").select("palette_name", "key", F.col("enabled").alias("_own"))
    legacy = enabled.where("palette_name is null").select("key", F.col("enabled").alias("_legacy"))
    return palette.join(own, ["palette_name", "key"], "left").join(legacy, "key", "left").select(*palette.columns, F.coalesce("_own", "_legacy", F.lit(True)).alias("enabled"))


def enabled_palette(palette: DataFrame, enabled: DataFrame) -> DataFrame:
    """Enabled colours in order, ordinals closed up."""
    return renumber(with_state(palette, enabled).where("enabled").drop("enabled"))


def renumber(palette: DataFrame) -> DataFrame:
    place = F.row_number().over(_by_palette().orderBy("ord")) - 1
    return palette.withColumn("ord", place.cast("int"))


def with_kind_or_tag(palette: DataFrame, *wanted: str) -> DataFrame:
    """Colours of any of the kinds or free tags."""
    return palette.where(F.col("kind").isin(*wanted) | F.exists(F.coalesce("tags", F.array()), lambda t: t.isin(*wanted)))


def summary(palette: DataFrame, enabled: DataFrame) -> DataFrame:
    return with_state(palette, enabled).groupBy("palette_name").agg(F.concat_ws(" / ", F.count_if("enabled").cast("string"), F.count("*").cast("string")).alias("summary"))


def violations(palette: DataFrame) -> DataFrame:
    """palette_name, ord (null for the whole palette), reason."""
    bad_channel = F.exists(F.array("r", "g", "b"), lambda c: c.isNotNull() & ~c.between(0, 255))
    reason = F.when((F.col("kind") != "transparent") & F.expr("r is null or g is null or b is null"), "visible color without rgb").when(bad_channel, "channel out of range").when(~F.col("kind").isin(*schemas.KINDS), "unknown kind")
    rows = palette.select("palette_name", "ord", reason.alias("reason")).where("reason is not null")
    size = palette.groupBy("palette_name").agg(F.count("*").alias("n")).where(F.col("n") > schemas.MAX_COLORS)
    return rows.unionByName(size.select("palette_name", F.lit(None).cast("int").alias("ord"), F.lit("too many colors").alias("reason")))


def darkest(palette: DataFrame, by_luma: bool = False) -> DataFrame:
    """palette_name, ord of the darkest visible colour: lowest r + g + b, or luma (Rec. 709); the first of equals."""
    dark = F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722 if by_luma else F.col("r") + F.col("g") + F.col("b")
    return visible(palette).groupBy("palette_name").agg(F.min(F.struct(dark.alias("d"), "ord"))["ord"].alias("ord"))


def matte(palette: DataFrame, wanted: DataFrame) -> DataFrame:
    """palette_name, matte_key, r, g, b, warning: the colour of a wanted matte key in each palette.

    The key's own colour, else the visible colour nearest to a hex key, else the first visible one.
    """
    own = visible(palette)
    hexed = F.when(F.col("matte_key").rlike("^#[0-9a-fA-F]{6}$"), F.upper("matte_key"))
    channel = [F.conv(F.substring(hexed, at, 2), 16, 10).cast("int") for at in (2, 4, 6)]
    d = [F.col(c) - x for c, x in zip("rgb", channel, strict=True)]
    far = F.coalesce(d[0] * d[0] + d[1] * d[1] + d[2] * d[2], F.lit(0))
    ranked = own.join(wanted, "palette_name").select("palette_name", "matte_key", "r", "g", "b", (F.col("key") == F.col("matte_key")).alias("same"), far.alias("far"), hexed.isNotNull().alias("is_hex"), "ord")
    best = ranked.groupBy("palette_name", "matte_key").agg(F.min(F.struct((~F.col("same")).alias("other"), "far", "ord", "is_hex", "r", "g", "b")).alias("m"))
    warning = F.when(~F.col("m.other"), None).when(F.col("m.is_hex"), "nearest").otherwise("first")
    return best.select("palette_name", "matte_key", "m.r", "m.g", "m.b", warning.alias("warning"))


_CELLS = (16, 32, 64, 128, 256)


def _nearest_first(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """palette_name, r, g, b and _best: squared distance * 2^33 + _first, the least over held (palette_name, p_r, p_g, p_b, _first).

    Colours are held in cubes of several widths.  A colour takes the least cube with a held colour in it, which is no
    farther than some distance, and looks only into the cubes of that width within it.  Channels are 0 to 255.
    """
    key = ["palette_name", "_w", "_cr", "_cg", "_cb"]

    def cubed(rows: DataFrame, prefix: str) -> DataFrame:
        every = rows.withColumn("_w", F.explode(F.array(*map(F.lit, _CELLS))))
        return every.withColumns({f"_c{c}": F.floor(F.col(f"{prefix}{c}") / F.col("_w")).cast("int") for c in "rgb"})

    def square(values) -> Column:
        return sum((v.cast("long") * v for v in values), F.lit(0).cast("long"))

    far = square([F.col(c) - F.col(f"p_{c}") for c in "rgb"])
    some = cubed(held, "p_").groupBy(*key).agg(F.min(F.col("p_r") * 65536 + F.col("p_g") * 256 + F.col("p_b")).alias("_some"))
    some = some.select(*key, *(F.shiftright("_some", at).bitwiseAND(F.lit(255)).alias(f"p_{c}") for c, at in zip("rgb", (16, 8, 0), strict=True)))
    reach = cubed(wanted, "").join(some, key).groupBy("palette_name", *"rgb").agg(F.min(F.col("_w").cast("long") * (1 << 20) + far).alias("_reach"))
    near = reach.select("palette_name", *"rgb", F.shiftright("_reach", 20).cast("int").alias("_w"), F.col("_reach").bitwiseAND(F.lit((1 << 20) - 1)).alias("_far"))
    span = F.ceil(F.sqrt("_far")).cast("int")
    for c in "rgb":
        near = near.withColumn(f"_c{c}", F.explode(F.sequence(*(F.floor((F.col(c) + s) / F.col("_w")).cast("int") for s in (-span, span)))))
    low = {c: F.col(f"_c{c}") * F.col("_w") for c in "rgb"}
    near = near.where(square([F.greatest(F.lit(0), low[c] - F.col(c), F.col(c) - low[c] - F.col("_w") + 1) for c in "rgb"]) <= F.col("_far"))
    return near.join(cubed(held, "p_"), key).groupBy("palette_name", *"rgb").agg(F.min(far * (1 << 33) + F.col("_first")).alias("_best"))


def inherit_state(imported: DataFrame, previous: DataFrame, enabled: DataFrame) -> DataFrame:
    """palette_name, key, enabled of imported colours that overwrite a stored palette.

    The state of the same key, else that of the previous colour nearest in squared sRGB (the first of equals), else true.
    """
    before = visible(with_state(previous, enabled)).groupBy("palette_name", *(F.col(c).alias(f"p_{c}") for c in "rgb")).agg(F.min(F.col("ord").cast("long") * 2 + F.col("enabled").cast("long")).alias("_first"))
    exact = enabled.select("palette_name", "key", F.col("enabled").alias("exact"))
    best = _nearest_first(visible(imported).select("palette_name", *"rgb").distinct(), before)
    near = visible(imported).select("palette_name", "key", *"rgb").distinct().join(best, ["palette_name", *"rgb"]).groupBy("palette_name", "key").agg((F.min("_best") % 2 == 1).alias("near"))
    return imported.join(exact, ["palette_name", "key"], "left").join(near, ["palette_name", "key"], "left").select("palette_name", "key", F.coalesce("exact", "near", F.lit(True)).alias("enabled"))


def collisions(imported: DataFrame, stored: DataFrame) -> DataFrame:
    """palette_name, old_colors, new_colors of imported palettes that would overwrite a stored one."""
    new = imported.groupBy("palette_name").agg(F.count("*").alias("new_colors"))
    return stored.groupBy("palette_name").agg(F.count("*").alias("old_colors")).join(new, "palette_name")


def merge(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported palettes replace those of the same name; the others stay."""
    return stored.join(imported.select("palette_name").distinct(), "palette_name", "left_anti").unionByName(imported)


def prune_state(palette: DataFrame, enabled: DataFrame) -> DataFrame:
    """palette_name, key, enabled of exactly the colours that exist; true where nothing was stored."""
    return with_state(palette, enabled).select("palette_name", "key", "enabled")


def set_state(state: DataFrame, action: str, keys: list[str] | None = None) -> DataFrame:
    """``enable``, ``disable``, ``invert`` or ``toggle`` (enable all if any is disabled) of all or the given keys."""
    chosen = F.lit(True) if keys is None else F.col("key").isin(keys)
    some_off = F.max(F.when(chosen, ~F.col("enabled"))).over(_by_palette())
    new = {"enable": F.lit(True), "disable": F.lit(False), "invert": ~F.col("enabled"), "toggle": some_off}[action]
    return state.withColumn("enabled", F.when(chosen, new).otherwise(F.col("enabled")))


def unique_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """seq, name, unique_name: each wanted name in order of seq takes its first free form: name, name 2, name 3, ..."""
    clean = wanted.select("seq", clean_name(F.col("name"), "Custom palette").alias("name"))
    numbered = clean.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("seq")))
    most = numbered.groupBy("name").agg(F.max("k").alias("k"))
    used = taken.select(F.regexp_replace("name", r" \d+$", "").alias("base"), F.col("name").alias("held")).unionByName(taken.select(F.col("name").alias("base"), F.col("name").alias("held"))).distinct()
    per_base = used.groupBy(F.col("base").alias("name")).agg(F.collect_set("held").alias("held"))
    counted = most.join(per_base, "name", "left").select("name", "k", F.coalesce("held", F.array().cast("array<string>")).alias("held"))
    forms = F.transform(F.sequence(F.lit(1), (F.col("k") + F.size("held") + 1).cast("int")), lambda i: F.when(i == 1, F.col("name")).otherwise(F.concat_ws(" ", "name", i.cast("string"))))
    free = counted.select("name", F.posexplode(F.filter(forms, lambda f: ~F.array_contains("held", f))).alias("at", "unique_name"))
    return numbered.join(free.withColumn("k", F.col("at") + 1), ["name", "k"]).select("seq", "name", "unique_name")


def create(palette: DataFrame, wanted: DataFrame) -> DataFrame:
    """The palettes and a new one of only Transparent for each wanted (seq, name), under the first free form of its name."""
    taken = palette.select(F.col("palette_name").alias("name")).distinct()
    empty = {"ord": F.lit(0), "key": F.lit("transparent"), "name": F.lit("Transparent"), "kind": F.lit("transparent"), "tags": F.lit(None).cast("array<string>")}
    new = unique_names(wanted, taken).select(F.col("unique_name").alias("palette_name"), *(empty.get(c, F.lit(None).cast("int")).alias(c) for c in ("ord", "key", "name", "kind", "r", "g", "b", "tags")))
    return palette.select(*new.columns).unionByName(new)


def delete(palette: DataFrame, names: DataFrame, builtin: tuple[str, ...] = (DEFAULT_NAME,)) -> tuple[DataFrame, DataFrame]:
    """The palettes without those named (palette_name), and the names that are rejected: built-in or unknown ones."""
    custom = palette.where(~F.col("palette_name").isin(*builtin)).select("palette_name").distinct()
    rejected = names.distinct().join(custom, "palette_name", "left_anti").select("palette_name", F.lit("not a custom palette").alias("reason"))
    return palette.join(names.join(custom, "palette_name", "left_semi"), "palette_name", "left_anti"), rejected


def edit(palette: DataFrame, edits: DataFrame, builtin: tuple[str, ...] = (DEFAULT_NAME,)) -> tuple[DataFrame, DataFrame]:
    """Apply edits (palette_name, action, key, new_key, name) to custom palettes.

    ``delete`` drops a colour, ``recolor`` gives it a new hex key (and name, if given), ``add`` appends one; Transparent
    goes behind what is added.  Returns the edited palettes and the rejected edits with a reason; new visible colours are
    of kind custom.  All edits are judged against the palette as it was.  Built-in palettes and Transparent stay; of
    several edits of one colour, or to one new key, the first by action and key is taken; additions stop at 256 colours.
    """
    known = palette.groupBy("palette_name", "key").agg(F.max("kind").alias("_known"))
    taken = known.select("palette_name", F.col("key").alias("new_key"), F.lit(True).alias("_clash"))
    sizes = palette.groupBy("palette_name").agg(F.count("*").alias("_size"))
    checked = edits.withColumn("new_key", normalize_hex(F.col("new_key"))).join(known, ["palette_name", "key"], "left").join(taken, ["palette_name", "new_key"], "left").join(sizes, "palette_name", "left")
    adds, deletes = F.col("action") == "add", F.col("action") == "delete"
    alone = (
        F.when(F.col("palette_name").isin(*builtin), "built-in palette")
        .when(F.col("_size").isNull(), "no such palette")
        .when(~F.col("action").isin("add", "recolor", "delete"), "unknown action")
        .when(~adds & F.col("_known").isNull(), "no such color")
        .when(~adds & (F.col("_known") == "transparent"), "transparent color")
        .when(~deletes & F.col("new_key").isNull(), "invalid color")
        .when(~deletes & F.col("_clash").isNotNull() & ~F.col("key").eqNullSafe(F.col("new_key")), "duplicate color")
    )
    turn = lambda what: F.row_number().over(Window.partitionBy("palette_name", what, F.col("_alone").isNull()).orderBy("action", "key", "name"))
    turns = checked.withColumn("_alone", alone).withColumns({"_of": turn(F.when(~adds, F.col("key"))), "_to": turn(F.when(~deletes, F.col("new_key")))})
    among = F.coalesce("_alone", F.when(~adds & (F.col("_of") > 1), "edited twice").when(~deletes & (F.col("_to") > 1), "duplicate color"))
    fit = turns.withColumn("_among", among)
    place = F.row_number().over(Window.partitionBy("palette_name", adds & F.col("_among").isNull()).orderBy("new_key"))
    reason = F.coalesce("_among", F.when(adds & (F.col("_size") + F.col("_place") > schemas.MAX_COLORS), "too many colors"))
    judged = fit.withColumn("_place", place).select("palette_name", "action", "key", "new_key", "name", reason.alias("reason"))
    good = judged.where("reason is null")
    gone = good.where("action = 'delete'").select("palette_name", "key")
    changed = good.where("action = 'recolor'").select("palette_name", "key", F.col("new_key").alias("_key"), F.col("name").alias("_name"))
    kept = palette.join(gone, ["palette_name", "key"], "left_anti").join(changed, ["palette_name", "key"], "left")
    recolored = F.col("_key").isNotNull()

    def channel(at: int, c: str) -> Column:
        return F.when(recolored, F.conv(F.substring("_key", at, 2), 16, 10).cast("int")).otherwise(F.col(c)).alias(c)

    edited = kept.select("palette_name", "ord", F.coalesce("_key", "key").alias("key"), F.coalesce("_name", "name").alias("name"), F.when(recolored, "custom").otherwise(F.col("kind")).alias("kind"), channel(2, "r"), channel(4, "g"), channel(6, "b"), "tags")
    last = palette.groupBy("palette_name").agg(F.max("ord").alias("_last"))
    added = good.where("action = 'add'").join(last, "palette_name").select(
        "palette_name",
        (F.col("_last") + F.row_number().over(_by_palette().orderBy("new_key"))).cast("int").alias("ord"),
        F.col("new_key").alias("key"),
        F.coalesce("name", "new_key").alias("name"),
        F.lit("custom").alias("kind"),
        *(F.conv(F.substring("new_key", at, 2), 16, 10).cast("int").alias(c) for c, at in zip("rgb", (2, 4, 6), strict=True)),
        F.lit(None).cast("array<string>").alias("tags"),
    )
    grown = added.groupBy("palette_name").agg(F.max("ord").alias("_end"))
    behind = F.when((F.col("kind") == "transparent") & F.col("_end").isNotNull(), F.col("_end") + 1 + F.col("ord")).otherwise(F.col("ord"))
    every = edited.unionByName(added).join(grown, "palette_name", "left").withColumn("ord", behind).drop("_end")
    return renumber(every), judged.where("reason is not null")


def duplicate(palette: DataFrame, name: str, new_name: str) -> DataFrame:
    """A copy of a palette under a new name; its visible colours become custom."""
    own = palette.where(F.col("palette_name") == name)
    return own.withColumns({"palette_name": F.lit(new_name), "kind": F.when(F.col("kind") == "transparent", "transparent").otherwise("custom")})


def prepared(palette: DataFrame) -> DataFrame:
    """palette_name, colors, transparent_index, fallback_index, warnings: what quantizing with each palette needs.

    The transparent index is -1 without such an entry; alpha-masked pixels then take the darkest visible colour.
    """
    first = truncate(palette)
    seen = F.expr(VISIBLE)
    facts = first.groupBy("palette_name").agg(
        F.count("*").alias("colors"),
        F.count_if(seen).alias("visible"),
        F.coalesce(F.min(F.when(F.col("kind") == "transparent", F.col("ord"))), F.lit(-1)).alias("transparent_index"),
        F.min(F.when(seen, F.struct((F.col("r") + F.col("g") + F.col("b")).alias("d"), "ord")))["ord"].alias("darkest"),
        F.max("truncated").alias("truncated"),
    )
    clear = F.col("transparent_index") >= 0
    warnings = F.array_compact(F.array(F.when(F.col("truncated"), "truncated"), F.when((F.col("visible") == 0) & clear, "only transparent"), F.when((F.col("visible") == 0) & ~clear, "no color"), F.when((F.col("visible") > 0) & ~clear, "no transparent")))
    return facts.select("palette_name", "colors", "transparent_index", F.when(clear, -1).otherwise(F.coalesce("darkest", F.lit(-1))).alias("fallback_index"), warnings.alias("warnings"))
