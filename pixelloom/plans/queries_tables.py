"""Registered queries on palettes, jobs, metrics, sources and the batch forms of streams, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom import schemas
from pixelloom.functions import text
from pixelloom.operators import jobs as J
from pixelloom.operators import metrics as M
from pixelloom.operators import palette as P
from pixelloom.plans import fixtures as fx
from pixelloom.sources import images as I
from pixelloom.sources import palettes as S
from pixelloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(query):
        QUERIES[name] = query
        if oracle:
            ORACLE_SQL[name] = oracle
        return query

    return add


# Palettes


@register("s6_default_palette", f"WITH {fx.DEFAULT}, p AS (SELECT l_partkey, count(*) AS lines FROM lineitem GROUP BY l_partkey) SELECT l_partkey, lines, key, name, kind FROM p JOIN pal ON ord = l_partkey % 64")
def s6_default_palette(spark, sf_dir):
    """A colour of the built-in palette for every part that was ordered."""
    lines = fx.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("lines"))
    pal = S.default_palette(spark).select("ord", "key", "name", "kind")
    return lines.join(F.broadcast(pal), F.col("ord") == F.col("l_partkey") % 64).drop("ord")


@register("p5_enabled_palette", f"WITH {fx.STATED} SELECT palette_name, (row_number() OVER (PARTITION BY palette_name ORDER BY ord) - 1)::INT AS ord, key, name, kind, r, g, b, tags FROM stated WHERE enabled")
def p5_enabled_palette(spark, sf_dir):
    return P.enabled_palette(fx.part_palettes(spark, sf_dir), fx.part_state(spark, sf_dir))


@register("w3_stable_ordinal", f"WITH {fx.PART_PALETTES} SELECT palette_name, key, name, (row_number() OVER (PARTITION BY palette_name ORDER BY ord) - 1)::INT AS ord FROM part_palettes WHERE r IS NOT NULL AND r > 99")
def w3_stable_ordinal(spark, sf_dir):
    return P.renumber(fx.part_palettes(spark, sf_dir).where("r > 99")).select("palette_name", "key", "name", "ord")


@register("p6_visible_colors", f"WITH {fx.PART_PALETTES} SELECT palette_name, ord, key FROM part_palettes WHERE kind <> 'transparent' AND r IS NOT NULL")
def p6_visible_colors(spark, sf_dir):
    return P.visible(fx.part_palettes(spark, sf_dir)).select("palette_name", "ord", "key")


@register("p7_by_kind_or_tag", f"WITH {fx.PART_PALETTES} SELECT palette_name, ord, kind, tags FROM part_palettes WHERE kind IN ('transparent', 'cold') OR list_has_any(coalesce(tags, []), ['transparent', 'cold'])")
def p7_by_kind_or_tag(spark, sf_dir):
    return P.with_kind_or_tag(fx.part_palettes(spark, sf_dir), "transparent", "cold").select("palette_name", "ord", "kind", "tags")


@register("p9_validate_palette", f"WITH {fx.PART_PALETTES} SELECT palette_name, ord, 'channel out of range' AS reason FROM part_palettes WHERE r + 40 > 255 OR g + 40 > 255 OR b + 40 > 255 UNION ALL SELECT palette_name, NULL, 'too many colors' FROM part_palettes GROUP BY palette_name HAVING count(*) > 256")
def p9_validate_palette(spark, sf_dir):
    """Palettes whose channels were all raised by 40."""
    return P.violations(fx.part_palettes(spark, sf_dir).withColumns({c: F.col(c) + 40 for c in "rgb"}))


@register("p11_palette_summary", f"WITH {fx.STATED} SELECT palette_name, count(*) FILTER (enabled) || ' / ' || count(*) AS summary FROM stated GROUP BY palette_name")
def p11_palette_summary(spark, sf_dir):
    return P.summary(fx.part_palettes(spark, sf_dir), fx.part_state(spark, sf_dir))


@register("j8_enabled_state", f"WITH {fx.STATED} SELECT palette_name, ord, key, enabled FROM stated")
def j8_enabled_state(spark, sf_dir):
    return P.with_state(fx.part_palettes(spark, sf_dir), fx.part_state(spark, sf_dir)).select("palette_name", "ord", "key", "enabled")


@register("u3_prune_enabled", f"WITH {fx.STATED} SELECT palette_name, key, enabled FROM stated")
def u3_prune_enabled(spark, sf_dir):
    return P.prune_state(fx.part_palettes(spark, sf_dir), fx.part_state(spark, sf_dir))


@register("a5_darkest_visible", f"WITH {fx.PART_PALETTES} SELECT palette_name, arg_min(ord, (r + g + b, ord)) AS ord, arg_min(ord, (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE, ord)) AS luma_ord FROM part_palettes WHERE r IS NOT NULL GROUP BY palette_name")
def a5_darkest_visible(spark, sf_dir):
    p = fx.part_palettes(spark, sf_dir)
    return P.darkest(p).join(P.darkest(p, by_luma=True).withColumnRenamed("ord", "luma_ord"), "palette_name")


@register("a4_palette_ranges", f"WITH {fx.PART_PALETTES} SELECT palette_name, {', '.join(f'greatest(max({c}) - min({c}), 2.220446049250313e-16::DOUBLE) AS range_{c}' for c in 'rgb')} FROM part_palettes WHERE r IS NOT NULL GROUP BY palette_name")
def a4_palette_ranges(spark, sf_dir):
    own = P.visible(fx.part_palettes(spark, sf_dir))
    return own.groupBy("palette_name").agg(*(F.greatest((F.max(c) - F.min(c)).cast("double"), F.lit(schemas.EPSILON)).alias(f"range_{c}") for c in "rgb"))


_MATTES = ("#FFFFFF", "#102030", "none")


@register(
    "j10_matte_resolve",
    f"""WITH {fx.PART_PALETTES}, wanted(matte_key, mr, mg, mb) AS (VALUES ('#FFFFFF', 255, 255, 255), ('#102030', 16, 32, 48), ('none', NULL, NULL, NULL)),
    ranked AS (SELECT palette_name, matte_key, mr, r, g, b, ord, key <> matte_key AS other, coalesce((r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb), 0) AS far, row_number() OVER (PARTITION BY palette_name, matte_key ORDER BY key <> matte_key, coalesce((r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb), 0), ord) AS k
        FROM part_palettes, wanted WHERE r IS NOT NULL)
    SELECT palette_name, matte_key, r, g, b, CASE WHEN other THEN CASE WHEN mr IS NULL THEN 'first' ELSE 'nearest' END END AS warning FROM ranked WHERE k = 1""",
)
def j10_matte_resolve(spark, sf_dir):
    p = fx.part_palettes(spark, sf_dir)
    return P.matte(p, p.select("palette_name").distinct().withColumn("matte_key", F.explode(F.array(*map(F.lit, _MATTES)))))


_IMPORTED = "imported AS (SELECT palette_name, ord, printf('#%02X%02X%02X', (r + 1) % 256, g, b) AS key, name, kind, (r + 1) % 256 AS r, g, b, tags FROM part_palettes WHERE r IS NOT NULL AND ord % 3 <> 0 AND palette_name < 'Brand#4')"


def _imported(spark, sf_dir) -> DataFrame:
    """Two thirds of some palettes, their red raised by one."""
    p = fx.part_palettes(spark, sf_dir).where("r is not null and ord % 3 <> 0 and palette_name < 'Brand#4'").withColumn("r", (F.col("r") + 1) % 256)
    return p.withColumn("key", text.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")))


@register(
    "j9_remap_enabled",
    f"""WITH {fx.STATED}, {_IMPORTED},
    near AS (SELECT i.palette_name, i.ord, arg_min(s.enabled, ((i.r - s.r) * (i.r - s.r) + (i.g - s.g) * (i.g - s.g) + (i.b - s.b) * (i.b - s.b), s.ord)) AS near FROM imported i JOIN stated s ON s.palette_name = i.palette_name AND s.r IS NOT NULL GROUP BY ALL)
    SELECT DISTINCT i.palette_name, i.key, coalesce(e.enabled, near, true) AS enabled FROM imported i JOIN near USING (palette_name, ord) LEFT JOIN part_state e ON e.palette_name = i.palette_name AND e.key = i.key""",
)
def j9_remap_enabled(spark, sf_dir):
    state = fx.part_state(spark, sf_dir)
    return P.inherit_state(_imported(spark, sf_dir), fx.part_palettes(spark, sf_dir), state).distinct()


@register("j14_overwrite_names", f"WITH {fx.PART_PALETTES}, {_IMPORTED} SELECT palette_name, (SELECT count(*) FROM part_palettes p WHERE p.palette_name = i.palette_name) AS old_colors, count(*) AS new_colors FROM imported i GROUP BY palette_name")
def j14_overwrite_names(spark, sf_dir):
    return P.collisions(_imported(spark, sf_dir), fx.part_palettes(spark, sf_dir))


@register("u2_import_merge", f"WITH {fx.PART_PALETTES}, {_IMPORTED} SELECT * FROM part_palettes WHERE palette_name NOT IN (SELECT palette_name FROM imported) UNION ALL SELECT * FROM imported")
def u2_import_merge(spark, sf_dir):
    return P.merge(fx.part_palettes(spark, sf_dir), _imported(spark, sf_dir))


@register("l1_truncate_palette", f"WITH {fx.PART_PALETTES}, all_in_one AS (SELECT 'all' AS palette_name, (row_number() OVER (ORDER BY palette_name, ord) - 1)::INT AS ord, key FROM part_palettes) SELECT palette_name, ord, key, (SELECT count(*) > 256 FROM part_palettes) AS truncated FROM all_in_one WHERE ord < 256")
def l1_truncate_palette(spark, sf_dir):
    """All palettes of the brands as one long palette, cut at 256 colours."""
    p = fx.part_palettes(spark, sf_dir)
    counts = p.groupBy("palette_name").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("palette_name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per brand
    one = p.join(counts.select("palette_name", before.alias("before")), "palette_name").select(F.lit("all").alias("palette_name"), (F.col("before") + F.col("ord")).cast("int").alias("ord"), "key")
    return P.truncate(one)


@register("u1_all_palettes", f"WITH {fx.PART_PALETTES}, {fx.DEFAULT} SELECT palette_name, ord, key, kind FROM part_palettes WHERE kind <> 'transparent' UNION ALL SELECT palette_name, max(ord) FILTER (kind <> 'transparent') + 1, 'transparent', 'transparent' FROM part_palettes GROUP BY palette_name HAVING count(*) FILTER (kind <> 'transparent') > 0 UNION ALL SELECT 'Default', ord, key, kind FROM pal")
def u1_all_palettes(spark, sf_dir):
    return S.all_palettes(fx.part_palettes(spark, sf_dir)).select("palette_name", "ord", "key", "kind")


@register(
    "u4_edit_colors",
    f"""WITH {fx.PART_PALETTES}, u AS (SELECT * FROM part_palettes p WHERE r IS NOT NULL AND (SELECT count(*) FROM part_palettes q WHERE q.palette_name = p.palette_name AND q.key = p.key) = 1),
    kept AS (SELECT palette_name, ord, key, kind FROM part_palettes p WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.palette_name = p.palette_name AND u.key = p.key AND u.ord % 5 = 0))
    SELECT palette_name, (row_number() OVER (PARTITION BY palette_name ORDER BY ord) - 1)::INT AS ord, CASE WHEN changed THEN '#010203' ELSE key END AS key, CASE WHEN changed THEN 'custom' ELSE kind END AS kind
    FROM (SELECT k.*, EXISTS (SELECT 1 FROM u WHERE u.palette_name = k.palette_name AND u.key = k.key AND u.ord = 1) AS changed FROM kept k)""",
)
def u4_edit_colors(spark, sf_dir):
    """Every fifth colour deleted and the second one recoloured, in every palette, where its key is unique."""
    p = fx.part_palettes(spark, sf_dir)
    once = p.where("r is not null").join(p.groupBy("palette_name", "key").agg(F.count("*").alias("n")).where("n = 1").drop("n"), ["palette_name", "key"])
    action = F.when(F.col("ord") % 5 == 0, "delete").when(F.col("ord") == 1, "recolor")
    edits = once.select("palette_name", action.alias("action"), "key", F.lit("#010203").alias("new_key"), F.lit(None).cast("string").alias("name")).where("action is not null")
    return P.edit(p, edits)[0].select("palette_name", "ord", "key", "kind")


@register("u4_create_palettes", f"WITH {fx.PART_PALETTES} SELECT palette_name, ord, key, kind FROM part_palettes UNION ALL SELECT DISTINCT palette_name || ' 2', 0, 'transparent', 'transparent' FROM part_palettes")
def u4_create_palettes(spark, sf_dir):
    """A new palette is wanted under the name of every palette."""
    p = fx.part_palettes(spark, sf_dir)
    wanted = p.groupBy("palette_name").agg(F.min(F.xxhash64("palette_name")).alias("seq")).select("seq", F.col("palette_name").alias("name"))
    return P.create(p, wanted).select("palette_name", "ord", "key", "kind")


@register("u4_delete_palettes", f"WITH {fx.PART_PALETTES} SELECT palette_name, ord, key FROM part_palettes WHERE palette_name NOT IN (SELECT palette_name FROM part_palettes GROUP BY palette_name HAVING count(*) % 2 = 0)")
def u4_delete_palettes(spark, sf_dir):
    """Palettes of an even number of colours, and the built-in one, are to go."""
    p = fx.part_palettes(spark, sf_dir)
    even = p.groupBy("palette_name").agg(F.count("*").alias("n")).where("n % 2 = 0").select("palette_name")
    return P.delete(p, even.unionByName(spark.range(1).select(F.lit("Default").alias("palette_name"))))[0].select("palette_name", "ord", "key")


@register("u5_set_enabled", f"WITH {fx.STATED} SELECT palette_name, ord, NOT enabled AS inverted, CASE WHEN r IS NOT NULL AND r < 128 THEN bool_or(NOT enabled) FILTER (r < 128) OVER (PARTITION BY palette_name) ELSE enabled END AS toggled FROM stated")
def u5_set_enabled(spark, sf_dir):
    """All inverted; and the darker half toggled together."""
    state = P.with_state(fx.part_palettes(spark, sf_dir), fx.part_state(spark, sf_dir))
    inverted = P.set_state(state, "invert").select("palette_name", "ord", F.col("enabled").alias("inverted"))
    group = F.coalesce(F.col("r") < 128, F.lit(False))
    marked = state.withColumn("key", F.when(group, "in").otherwise("out"))
    return inverted.join(P.set_state(marked, "toggle", ["in"]).select("palette_name", "ord", F.col("enabled").alias("toggled")), ["palette_name", "ord"])


@register("u6_distinct_tags", "SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform([p_brand, ' ' || p_brand, p_type, '', p_name], lambda t: left(trim(t), 32)), lambda t: t <> ''))) AS tags FROM part")
def u6_distinct_tags(spark, sf_dir):
    tags = F.array("p_brand", F.concat(F.lit(" "), "p_brand"), "p_type", F.lit(""), "p_name")
    return fx.table(spark, sf_dir, "part").select("p_partkey", F.array_sort(text.clean_tags(tags)).alias("tags"))


@register("w4_unique_palette_name", "WITH n AS (SELECT p_partkey AS seq, p_brand AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) SELECT seq, name, CASE WHEN name >= 'Brand#3' THEN name || CASE WHEN k = 1 THEN '' ELSE ' ' || k END ELSE name || ' ' || CASE WHEN k = 1 THEN 2 ELSE k + 2 END END AS unique_name FROM n")
def w4_unique_palette_name(spark, sf_dir):
    """Names of brands below Brand#3 are taken as they are and with a 3."""
    part = fx.table(spark, sf_dir, "part")
    taken = part.where("p_brand < 'Brand#3'").select("p_brand").distinct().select(F.explode(F.array("p_brand", F.concat("p_brand", F.lit(" 3")))).alias("name"))
    return P.unique_names(part.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("name")), taken)


@register("q0_prepare_palette", f"""WITH {fx.PART_PALETTES}, f AS (SELECT palette_name, count(*) AS colors, coalesce(min(ord) FILTER (kind = 'transparent'), -1) AS transparent_index, arg_min(ord, (r + g + b, ord)) FILTER (r IS NOT NULL) AS dark FROM part_palettes WHERE ord < 256 GROUP BY palette_name)
    SELECT palette_name, colors, transparent_index, CASE WHEN transparent_index >= 0 THEN -1 ELSE dark END AS fallback_index,
    list_filter([CASE WHEN (SELECT count(*) FROM part_palettes p WHERE p.palette_name = f.palette_name) > 256 THEN 'truncated' END, CASE WHEN dark IS NULL AND transparent_index >= 0 THEN 'only transparent' END, CASE WHEN dark IS NULL AND transparent_index < 0 THEN 'no color' END, CASE WHEN dark IS NOT NULL AND transparent_index < 0 THEN 'no transparent' END], lambda w: w IS NOT NULL) AS warnings FROM f""")
def q0_prepare_palette(spark, sf_dir):
    return P.prepared(fx.part_palettes(spark, sf_dir))


@register("s4_read_palettes", f"WITH {fx.PART_PALETTES}, n AS (SELECT *, count(*) OVER (PARTITION BY palette_name, key) AS k FROM part_palettes) SELECT palette_name, ord, key, CASE WHEN kind = 'transparent' THEN 'transparent' ELSE 'custom' END AS kind, r, g, b, CASE WHEN k > 1 THEN 'duplicate color' END AS error FROM n")
def s4_read_palettes(spark, sf_dir):
    """Palettes as import documents, parsed."""
    p = fx.part_palettes(spark, sf_dir)
    entry = F.struct("ord", "name", "key", F.lit(None).cast("string").alias("hex"), "kind", "tags")
    packed = p.groupBy(F.concat(F.lit("  "), "palette_name", F.lit(" ")).alias("name")).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    documents = packed.select("name", F.transform("c", lambda e: F.struct(e["name"].alias("name"), e["key"].alias("key"), e["hex"].alias("hex"), e["kind"].alias("kind"), e["tags"].alias("tags"))).alias("colors"))
    return S.parse_palettes(documents).select("palette_name", "ord", "key", "kind", "r", "g", "b", "error")


@register("s5_write_palettes", f"WITH {fx.PART_PALETTES} SELECT palette_name AS name, string_agg(key, ',' ORDER BY ord) AS keys FROM part_palettes GROUP BY palette_name")
def s5_write_palettes(spark, sf_dir):
    return S.export_palettes(fx.part_palettes(spark, sf_dir)).select("name", F.concat_ws(",", F.transform("colors", lambda c: c["key"])).alias("keys"))


# Functions on texts


@register("f10_hex", "SELECT c_custkey, printf('#%02X%02X%02X', (c_custkey % 256)::INT, ((c_custkey * 7) % 256)::INT, ((c_custkey * 3) % 256)::INT) AS hex, (c_custkey % 256)::INT AS r, ((c_custkey * 7) % 256)::INT AS g, printf('#%X%X%X%X%X%X', (c_custkey % 16)::INT, (c_custkey % 16)::INT, ((c_custkey * 7) % 16)::INT, ((c_custkey * 7) % 16)::INT, ((c_custkey * 3) % 16)::INT, ((c_custkey * 3) % 16)::INT) AS short, NULL::VARCHAR AS bad FROM customer")
def f10_hex(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    rgb = [k % 256, (k * 7) % 256, (k * 3) % 256]
    short = F.concat(F.lit(" #"), *(F.lower(F.hex(v)) for v in (k % 16, (k * 7) % 16, (k * 3) % 16)))
    named = fx.table(spark, sf_dir, "customer").select("c_custkey", text.rgb_to_hex(*rgb).alias("hex"), text.normalize_hex(short).alias("short"), text.normalize_hex(F.concat(F.lit("#xyz"), "c_name")).alias("bad"))
    return named.select("c_custkey", "hex", text.hex_channel(F.col("hex"), 0).alias("r"), text.hex_channel(F.col("hex"), 1).alias("g"), "short", "bad")


@register("f11_clean_name", "SELECT c_custkey, coalesce(nullif(left(trim(CASE WHEN c_custkey % 5 = 0 THEN '   ' ELSE '  ' || repeat(c_name, 5) END), 64), ''), 'Custom palette') AS name FROM customer")
def f11_clean_name(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 5 == 0, "   ").otherwise(F.concat(F.lit("  "), F.repeat("c_name", 5)))
    return fx.table(spark, sf_dir, "customer").select("c_custkey", text.clean_name(raw, "Custom palette").alias("name"))


@register("s9_export_name", "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(trim(regexp_replace(p_name || '.tar.png', '\\.[^.]+$', '')), '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'image') || '-out-' || p_size || 'x7.png' AS file FROM part")
def s9_export_name(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select("p_partkey", text.export_name(F.concat("p_name", F.lit(".tar.png")), F.lit("out"), F.col("p_size"), F.lit(7)).alias("file"))


def _half_up(unit: str, size: int, decimals: int) -> str:
    """DuckDB text of v bytes in a unit; halves go up, as in format_bytes, where printf alone takes the even digit."""
    return f"printf('%.{decimals}f {unit}', floor(v / {size}.0::DOUBLE * {10**decimals} + 0.5) / {10**decimals})"


_BYTES_SQL = f"SELECT o_orderkey, CASE WHEN v < 1024 THEN v || ' B' WHEN v < 10240 THEN {_half_up('KiB', 1024, 1)} WHEN v < 1048576 THEN {_half_up('KiB', 1024, 0)} WHEN v < 10485760 THEN {_half_up('MiB', 1048576, 1)} ELSE {_half_up('MiB', 1048576, 0)} END AS size FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 31) % 500000001 AS v FROM orders)"


@register("f20_format_bytes", _BYTES_SQL)
@register("f20_format_bytes_all", _BYTES_SQL)
def f20_format_bytes(spark, sf_dir):
    k = F.col("o_orderkey")
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", text.format_bytes((k * k * 31) % 500000001).alias("size"))


@register(
    "f20_formats",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN d = 0 THEN '0%' WHEN d >= 0.1 THEN printf('%.1f%%', d * 100) ELSE printf('%.2f%%', d * 100) END AS percent,
    CASE WHEN ms = 0 THEN '0ms' WHEN ms < 10 THEN printf('%.2fms', ms) WHEN ms < 100 THEN printf('%.1fms', ms) ELSE floor(ms + 0.5)::BIGINT || 'ms' END AS debug_ms, CASE WHEN ms >= 100 THEN floor(ms + 0.5)::BIGINT || 'ms' ELSE printf('%.1fms', ms) END AS stage_ms
    FROM (SELECT *, l_discount::DOUBLE AS d, (CASE l_linenumber % 3 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_quantity ELSE l_quantity - 1 END)::DOUBLE AS ms FROM lineitem)""",
)
def f20_formats(spark, sf_dir):
    third = F.col("l_linenumber") % 3
    ms = F.when(third == 0, F.col("l_extendedprice")).when(third == 1, F.col("l_quantity")).otherwise(F.col("l_quantity") - 1).cast("double")
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", text.format_percent(F.col("l_discount").cast("double")).alias("percent"), text.format_ms(ms).alias("debug_ms"), text.format_stage_ms(ms).alias("stage_ms"))


@register(
    "f20_counts",
    """SELECT o_orderkey, CASE WHEN v >= 1000000 THEN printf('%.1fM', m) WHEN v >= 1000 THEN k || 'K' ELSE v || '' END AS n, CASE WHEN v >= 1000000 THEN printf('%.1fMP', m) WHEN v >= 1000 THEN k || 'K' ELSE v || '' END AS pixels
    FROM (SELECT o_orderkey, v, floor(v / 1e6::DOUBLE * 10 + 0.5) / 10 AS m, floor(v / 1e3::DOUBLE + 0.5)::BIGINT AS k FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 31) % [900, 800001, 90000001][o_orderkey % 3 + 1] AS v FROM orders))""",
)
def f20_counts(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    v = (k * k * 31) % F.element_at(F.array(F.lit(900), F.lit(800001), F.lit(90000001)), (k % 3 + 1).cast("int"))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", text.format_count(v).alias("n"), text.format_pixels(v).alias("pixels"))


# Jobs


@register(
    "p10_validate_jobs",
    f"""WITH {fx.JOBS}, j AS (SELECT job_id, list_filter([CASE WHEN width NOT BETWEEN 1 AND 16384 THEN 'width' END, CASE WHEN height NOT BETWEEN 1 AND 16384 THEN 'height' END, CASE WHEN width::BIGINT * height > 67108864 THEN 'pixels' END, CASE WHEN resize = 'cubic' THEN 'resize' END,
    CASE WHEN alpha_threshold > 255 THEN 'alpha_threshold' END, CASE WHEN dither = 'blue' THEN 'dither' END, CASE WHEN strength < 0 THEN 'strength' END, CASE WHEN radius < 0 THEN 'radius' END, CASE WHEN crop_width = 0 THEN 'crop' END], lambda r: r IS NOT NULL) AS reasons FROM jobs) SELECT * FROM j WHERE len(reasons) > 0""",
)
def p10_validate_jobs(spark, sf_dir):
    return J.violations(fx.jobs(spark, sf_dir))


@register("f19_vector_dither_applies", f"WITH {fx.JOBS} SELECT job_id, use_color_space AND dither <> 'none' AND color_space <> 'weighted-rgb' AS applies FROM jobs")
def f19_vector_dither_applies(spark, sf_dir):
    return fx.jobs(spark, sf_dir).select("job_id", J.vector_dither_applies(F.col("dither"), F.col("use_color_space"), F.col("color_space")).alias("applies"))


_CROP = "CASE WHEN crop_x IS NULL THEN '0,0,full,full' ELSE concat_ws(',', crop_x, crop_y, crop_width, crop_height) END"


@register("f18_branch_key", f"WITH {fx.JOBS} SELECT image_id || '|' || width || 'x' || height || '|' || resize || '|' || {_CROP} AS branch, count(*) AS n FROM jobs GROUP BY 1")
def f18_branch_key(spark, sf_dir):
    return fx.jobs(spark, sf_dir).withColumn("branch", J.branch_key(F.col("job_id"))).groupBy("branch").agg(F.count("*").alias("n"))


_JSON_CROP = " || ".join(f"""',"{c}":' || coalesce({c}::VARCHAR, 'null')""" for c in ("crop_height", "crop_width", "crop_x", "crop_y"))
_IDENTITY = f"""{fx.PART_PALETTES}, {fx.DEFAULT}, every AS (SELECT palette_name, ord, key, kind, r, g, b FROM part_palettes UNION ALL SELECT 'Default', ord, key, kind, r, g, b FROM pal),
    packed AS (SELECT palette_name, '[' || string_agg('{{"key":"' || key || '","kind":"' || kind || '","rgb":' || CASE WHEN r IS NULL THEN 'null' ELSE '{{"r":' || r || ',"g":' || g || ',"b":' || b || '}}' END || '}}', ',' ORDER BY ord) || ']' AS colors FROM every GROUP BY 1),
    identified AS (SELECT job_id, sha256('{{"alpha_mode":"' || alpha_mode || '","alpha_threshold":' || alpha_threshold || ',"color_space":"' || color_space || '","colors":' || coalesce(colors, 'null') || {_JSON_CROP} || ',"dither":"' || dither || '","height":' || height || ',"image_id":' || image_id || ',"matte_key":"#FFFFFF","palette_name":"' || palette_name || '","placement":"everywhere","radius":' || radius || ',"resize":"' || resize
    || '","seed":' || seed || ',"serpentine":' || serpentine || ',"softness":8,"strength":' || strength || ',"threshold":12,"use_color_space":' || use_color_space || ',"width":' || width || '}}') AS settings_hash FROM jobs LEFT JOIN packed USING (palette_name))"""


def _identified(spark, sf_dir) -> DataFrame:
    columns = ("palette_name", "ord", "key", "kind", "r", "g", "b")
    palettes = fx.part_palettes(spark, sf_dir).select(*columns).unionByName(S.default_palette(spark).select(F.lit("Default").alias("palette_name"), *columns[1:]))
    return J.with_identity(fx.jobs(spark, sf_dir), palettes, keep=["job_id"])


@register("f17_settings_identity", f"WITH {fx.JOBS}, {_IDENTITY} SELECT job_id, settings_hash FROM identified")
def f17_settings_identity(spark, sf_dir):
    return _identified(spark, sf_dir).select("job_id", "settings_hash")


@register(
    "q14_job_warnings",
    f"""WITH {fx.JOBS}, {fx.PART_PALETTES}, held AS (SELECT palette_name, count(*) AS n, count(*) FILTER (ord < 256 AND kind = 'transparent') AS clear, count(*) FILTER (ord < 256 AND kind <> 'transparent') AS visible FROM part_palettes GROUP BY 1)
    SELECT job_id, CASE WHEN coalesce(visible, 0) + coalesce(clear, 0) = 0 THEN ['error: no color'] ELSE list_filter([CASE WHEN n > 256 THEN 'palette truncated to 256 colors' END, CASE WHEN visible = 0 THEN 'only Transparent: every pixel is transparent' END,
        CASE WHEN visible > 0 AND clear = 0 AND alpha_mode = 'preserve' THEN 'no Transparent: masked pixels take the darkest color' END], lambda w: w IS NOT NULL) END AS warnings FROM jobs LEFT JOIN held USING (palette_name)""",
)
def q14_job_warnings(spark, sf_dir):
    return J.warnings(fx.jobs(spark, sf_dir), fx.part_palettes(spark, sf_dir))


def _identified_and_outputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Jobs with their identities, and outputs of every third job and of settings that nobody asks for now.

    Both sides read one exchange above Python, so Spark identifies the jobs once.  Their rows are told apart by a column
    that is made above it: then no filter, choice of columns or join of one side alone moves below the exchange.
    """
    identified = _identified(spark, sf_dir).repartition("job_id", "settings_hash")
    job, asked = F.col("job_id"), F.col("settings_hash")
    row = lambda job, identity, made: F.struct(job.alias("job_id"), identity.alias("settings_hash"), F.lit(made).alias("made"))
    rows = [row(job, asked, False), F.when(job % 3 == 0, row(job, asked, True)), F.when(job % 7 == 0, row(job + 10**9, F.sha2(asked, 256), True))]
    both = identified.select(F.inline(F.array_compact(F.array(*rows))))
    return both.where("not made").drop("made"), both.where("made").drop("made")


_OUTPUTS = f"{fx.JOBS}, {_IDENTITY}, outputs AS (SELECT * FROM identified WHERE job_id % 3 = 0 UNION ALL SELECT job_id + 1000000000, sha256(settings_hash) FROM identified WHERE job_id % 7 = 0)"


@register("j11_pending_jobs", f"WITH {_OUTPUTS} SELECT job_id FROM identified WHERE settings_hash NOT IN (SELECT settings_hash FROM outputs)")
def j11_pending_jobs(spark, sf_dir):
    identified, outputs = _identified_and_outputs(spark, sf_dir)
    return J.pending(identified, outputs).select("job_id")


@register("j12_stale_outputs", f"WITH {_OUTPUTS} SELECT job_id FROM outputs WHERE settings_hash NOT IN (SELECT settings_hash FROM identified)")
def j12_stale_outputs(spark, sf_dir):
    identified, outputs = _identified_and_outputs(spark, sf_dir)
    return J.stale(outputs, identified).select("job_id")


@register("j12_exportable_outputs", f"WITH {_OUTPUTS} SELECT job_id FROM outputs WHERE settings_hash IN (SELECT settings_hash FROM identified)")
def j12_exportable_outputs(spark, sf_dir):
    identified, outputs = _identified_and_outputs(spark, sf_dir)
    return J.exportable(outputs, identified).select("job_id")


@register("t6_exactly_once", f"WITH {_OUTPUTS} SELECT DISTINCT settings_hash FROM identified WHERE settings_hash NOT IN (SELECT settings_hash FROM outputs)")
def t6_exactly_once(spark, sf_dir):
    return streams.exactly_once(*_identified_and_outputs(spark, sf_dir)).select("settings_hash")


@register("a15_memory_estimate", f"WITH {fx.JOBS} SELECT job_id, 2000 AS source_bytes, width::BIGINT * height * 4 AS resized_bytes, width::BIGINT * height AS index_bytes, CASE WHEN use_color_space THEN width::BIGINT * height * 12 ELSE 0 END AS vector_bytes, CASE WHEN dither = 'sierra' THEN width::BIGINT * height * 12 ELSE 0 END AS work_bytes FROM jobs")
def a15_memory_estimate(spark, sf_dir):
    j = fx.jobs(spark, sf_dir).select("job_id", F.lit(25).alias("source_width"), F.lit(20).alias("source_height"), F.col("width").alias("out_width"), F.col("height").alias("out_height"), "dither", F.col("use_color_space").alias("in_vectors"))
    return M.memory_estimate(j)


_MATRIX = f"matrix AS (SELECT concat_ws('/', scale, resize, dither, color_space) AS case_id, * FROM (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS scale), (SELECT unnest({list(schemas.RESIZES)}) AS resize), (SELECT unnest({list(schemas.DITHERS)}) AS dither), (SELECT unnest({list(schemas.COLOR_SPACES)}) AS color_space))"


@register("j13_case_matrix", f"WITH {fx.JOBS}, {_MATRIX} SELECT case_id, count(job_id) AS jobs FROM matrix LEFT JOIN jobs USING (resize, dither, color_space) GROUP BY case_id")
def j13_case_matrix(spark, sf_dir):
    """Every case of the full study and how many jobs use its settings."""
    cases = J.case_matrix(spark)
    return cases.join(fx.jobs(spark, sf_dir), ["resize", "dither", "color_space"], "left").groupBy("case_id").agg(F.count("job_id").alias("jobs"))


@register("p8_validate_indexed", f"WITH {fx.PX_EVENTS} SELECT image_id, CASE image_id % 4 WHEN 0 THEN 'no palette' WHEN 1 THEN 'wrong pixel count' WHEN 2 THEN 'index outside palette' END AS reason FROM px_events WHERE image_id % 4 < 3 GROUP BY image_id")
def p8_validate_indexed(spark, sf_dir):
    """Outputs with a missing palette, a wrong size, or too high an index, by turns."""
    px = fx.px_events(spark, sf_dir)
    indexed = px.select("image_id", "y", "x", F.when((F.col("image_id") % 4 == 2) & (F.col("x") == 3), 64).otherwise(F.col("x")).alias("idx"))
    outputs = px.select("image_id").distinct().select("image_id", F.when(F.col("image_id") % 4 == 0, "none").otherwise("Default").alias("palette_name"), F.when(F.col("image_id") % 4 == 1, 24).otherwise(25).alias("width"), F.lit(20).alias("height"), F.lit(63).alias("transparent_index"))
    return J.validate_indexed(indexed, outputs, S.default_palette(spark))


@register("s7_write_indexed", f"WITH {fx.PX_EVENTS} SELECT image_id, y, x, r AS idx FROM px_events")
def s7_write_indexed(spark, sf_dir):
    """Indices packed to one binary per image row, and unpacked again."""
    return I.unpack_rows(I.pack_rows(fx.px_events(spark, sf_dir).select("image_id", "y", "x", F.col("r").alias("idx"))))


@register("s8_write_indexed_png")
def s8_write_indexed_png(spark, sf_dir):
    """A PNG of every image of the embeddings, in greys."""
    rows = I.pack_rows(fx.px_embed(spark, sf_dir).select("image_id", "y", "x", F.col("r").alias("idx")))
    return I.export_png(rows, [(v, v, v, False) for v in range(256)])


@register("s3_explode_pixels", f"WITH {fx.PX_EVENTS} SELECT * FROM px_events")
def s3_explode_pixels(spark, sf_dir):
    """Images packed as BGRA bytes, and taken apart again."""
    px = fx.px_events(spark, sf_dir)
    bytes_ = F.concat(*(F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "bgra"))
    packed = px.select("image_id", F.struct("y", "x", bytes_.alias("h")).alias("p")).groupBy("image_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    whole = packed.select("image_id", F.lit(25).alias("width"), F.lit(20).alias("height"), F.lit(4).alias("channels"), F.unhex(F.concat_ws("", F.transform("p", lambda e: e["h"]))).alias("data"))
    return I.explode_pixels(whole)


@register("s2_admit_images")
def s2_admit_images(spark, sf_dir):
    """The PNG files of s8, judged as binaryFile rows; every seventh one has lost its first byte."""
    made = s8_write_indexed_png(spark, sf_dir)
    broken = F.when(F.col("image_id") % 7 == 0, F.expr("substring(content, 2)")).otherwise(F.col("content"))
    return I.admit(made.select(F.concat(F.lit("image-"), F.col("image_id").cast("string")).alias("path"), F.octet_length("content").cast("long").alias("length"), broken.alias("content")))


# Metrics


@register(
    "a9_run_stats",
    f"""WITH {fx.RUNS}, b AS (SELECT case_id, source_id, stage, count(ms) AS n, min(ms) AS min, avg(ms) AS mean, max(ms) AS max, stddev_pop(ms) AS stddev, quantile_disc(ms, 0.25) AS q1, quantile_disc(ms, 0.5) AS median, quantile_disc(ms, 0.75) AS q3, quantile_disc(ms, 0.95) AS p95 FROM runs GROUP BY ALL),
    o AS (SELECT case_id, source_id, stage, count(*) FILTER (q3 > q1 AND (ms < q1 - 1.5 * (q3 - q1) OR ms > q3 + 1.5 * (q3 - q1))) AS outliers FROM runs JOIN b USING (case_id, source_id, stage) GROUP BY ALL)
    SELECT case_id, source_id, stage, n, min, round(mean, 4) AS mean, median, p95, max, round(stddev, 4) AS stddev, round(CASE WHEN mean = 0 THEN 0 ELSE stddev / mean END, 6) AS cv, outliers FROM b JOIN o USING (case_id, source_id, stage)""",
)
def a9_run_stats(spark, sf_dir):
    stats = M.run_stats(fx.runs(spark, sf_dir), ["case_id", "source_id", "stage"])
    return stats.withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 4), "cv": F.round("cv", 6)})


_SAMPLES = f"{fx.METRICS}, parts AS (SELECT key, seq, 'resize' AS name, ms FROM metrics UNION ALL SELECT key, seq, 'match', ms - 20 FROM metrics UNION ALL SELECT key, seq, 'total', ms * 2 FROM metrics)"


def _samples(spark, sf_dir) -> DataFrame:
    m = fx.metrics(spark, sf_dir)
    timing = lambda name, ms, replayed: F.struct(F.lit(name).alias("name"), ms.alias("ms"), replayed.alias("replayed"))
    timings = F.array(timing("resize", F.col("ms"), F.col("seq") % 2 == 0), timing("match", F.col("ms") - 20, F.col("seq") % 3 == 0))
    return m.select("key", "seq", "scope_key", (F.col("ms") * 2).alias("total_ms"), timings.alias("timings"))


@register("a10_timing_summary", f"WITH {_SAMPLES}, c AS (SELECT key, seq, name, greatest(ms, 0) AS ms FROM parts) SELECT key, name, count(*) AS n, arg_max(ms, seq) AS latest, round(avg(ms), 6) AS average, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.98) AS p98, quantile_disc(ms, 0.99) AS p99 FROM c GROUP BY key, name")
def a10_timing_summary(spark, sf_dir):
    return M.timing_summary(_samples(spark, sf_dir), ["key"]).withColumn("average", F.round("average", 6))


@register("l2_summary_order", f"WITH {_SAMPLES}, s AS (SELECT name, count(*) AS n FROM parts GROUP BY name) SELECT name, n, row_number() OVER (ORDER BY name <> 'total', name) AS place FROM s")
def l2_summary_order(spark, sf_dir):
    """The place of every name in the order of the report."""
    counted = M.timing_summary(_samples(spark, sf_dir), []).select("name", "n")
    place = F.row_number().over(Window.orderBy(F.col("name") != "total", "name"))  # a row per timing name
    return M.summary_order(counted).select("name", "n", place.alias("place"))


@register("a11_hotspot", f"WITH {fx.RUNS}, s AS (SELECT case_id, source_id, stage, round(avg(ms), 4) AS mean FROM runs GROUP BY ALL) SELECT case_id, source_id, arg_max(stage, (mean, -stage)) AS hotspot FROM s GROUP BY ALL")
def a11_hotspot(spark, sf_dir):
    means = fx.runs(spark, sf_dir).groupBy("case_id", "source_id", "stage").agg(F.round(F.avg("ms"), 4).alias("mean"))
    return M.hotspot(means, ["case_id", "source_id"], "stage", "mean", "stage")


@register("a12_hit_rates", f"WITH {fx.METRICS} SELECT key, round(sum(CASE WHEN name = 'view' THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN name IN ('view', 'click') THEN 1 ELSE 0 END), 0), 9) AS rate, round(avg(CASE WHEN ms > 50 THEN 1 ELSE 0 END), 9) AS reused FROM metrics GROUP BY key")
def a12_hit_rates(spark, sf_dir):
    m = fx.metrics(spark, sf_dir)
    one = lambda c: F.when(c, 1).otherwise(0)
    rate = M.hit_rate(one(F.col("name") == "view"), one(F.col("name") == "click"))
    return m.groupBy("key").agg(F.round(rate, 9).alias("rate"), F.round(F.avg((F.col("ms") > 50).cast("int")), 9).alias("reused"))


@register("a13_counter_delta", f"WITH {fx.METRICS} SELECT key, seq, seq - coalesce(lag(seq) OVER w, 0) AS hits, ms AS gauge FROM metrics WINDOW w AS (PARTITION BY key ORDER BY seq)")
def a13_counter_delta(spark, sf_dir):
    m = fx.metrics(spark, sf_dir).select("key", "seq", F.col("seq").alias("hits"), F.col("ms").alias("gauge"))
    return M.counter_delta(m, ["key"], "seq", ["hits"], ["gauge"])


@register("a14_merge_counts", f"WITH {fx.METRICS} SELECT key, name, sum(seq % 10)::BIGINT AS n FROM metrics GROUP BY key, name")
def a14_merge_counts(spark, sf_dir):
    parts = fx.metrics(spark, sf_dir).select("key", F.create_map("name", (F.col("seq") % 10)).alias("counts"))
    return M.merge_counts(parts, ["key"]).select("key", F.explode("counts").alias("name", "n"))


@register("a16_mean_rows", f"WITH {fx.RUNS} SELECT case_id, stage, round(avg(ms), 4) AS ms, round(avg(iteration), 4) AS iteration FROM runs GROUP BY case_id, stage")
def a16_mean_rows(spark, sf_dir):
    rows = M.mean_rows(fx.runs(spark, sf_dir), ["case_id", "stage"], ["ms", "iteration"])
    return rows.withColumns({"ms": F.round("ms", 4), "iteration": F.round("iteration", 4)})


@register("a18_replayed_ms", f"WITH {fx.METRICS} SELECT seq, CASE WHEN seq % 2 = 0 THEN ms ELSE 0 END + CASE WHEN seq % 3 = 0 THEN ms - 20 ELSE 0 END AS replayed_ms FROM metrics")
def a18_replayed_ms(spark, sf_dir):
    return M.replayed_ms(_samples(spark, sf_dir))


@register("s10_write_bench_csv", f"WITH {fx.RUNS}, s AS (SELECT case_id, source_id, stage, round(avg(ms), 4) AS mean FROM runs GROUP BY ALL) SELECT case_id, source_id, {', '.join(f'max(mean) FILTER (stage = {k}) AS stage_{k}' for k in range(1, 8))} FROM s GROUP BY ALL")
def s10_write_bench_csv(spark, sf_dir):
    means = fx.runs(spark, sf_dir).groupBy("case_id", "source_id", F.concat(F.lit("stage_"), F.col("stage").cast("string")).alias("stage")).agg(F.round(F.avg("ms"), 4).alias("mean"))
    return M.stage_table(means, ["case_id", "source_id"], "stage", "mean", [f"stage_{k}" for k in range(1, 8)])


_HISTORY = f"""{fx.METRICS}, c AS (SELECT *, CASE WHEN scope_key IS DISTINCT FROM lag(scope_key) OVER w THEN 1 ELSE 0 END AS changed FROM (SELECT * REPLACE (CASE WHEN seq % 400 < 300 THEN 'long' ELSE scope_key END AS scope_key) FROM metrics) WINDOW w AS (PARTITION BY key ORDER BY seq)),
    i AS (SELECT *, sum(changed) OVER (PARTITION BY key ORDER BY seq) AS island FROM c), k AS (SELECT *, max(island) OVER (PARTITION BY key) AS last, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM i), kept AS (SELECT * FROM k WHERE island = last AND back <= 100)"""


def _scoped(spark, sf_dir) -> DataFrame:
    return fx.metrics(spark, sf_dir).withColumn("scope_key", F.when(F.col("seq") % 400 < 300, "long").otherwise(F.col("scope_key")))


@register("w2_scoped_history", f"WITH {_HISTORY} SELECT key, seq, scope_key, ms FROM kept")
def w2_scoped_history(spark, sf_dir):
    return M.scoped_history(_scoped(spark, sf_dir), ["key"]).select("key", "seq", "scope_key", "ms")


@register("t4_rolling_timings", f"WITH {_HISTORY} SELECT key, max(scope_key) AS scope_key, count(*) AS n, round(avg(ms), 6) AS average, quantile_disc(ms, 0.95) AS p95 FROM kept GROUP BY key")
def t4_rolling_timings(spark, sf_dir):
    return streams.rolling_timings_batch(_scoped(spark, sf_dir)).withColumn("average", F.round("average", 6))


@register("l3_last_n", f"WITH {fx.METRICS} SELECT key, seq, ms FROM metrics QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) <= 100")
def l3_last_n(spark, sf_dir):
    return M.last_n(fx.metrics(spark, sf_dir), ["key"], "seq", 100).select("key", "seq", "ms")


@register("w5_latest", f"WITH {fx.METRICS} SELECT key, name, arg_max(ms, seq) AS latest FROM metrics GROUP BY key, name")
def w5_latest(spark, sf_dir):
    return fx.metrics(spark, sf_dir).groupBy("key", "name").agg(F.max_by("ms", "seq").alias("latest"))


@register("w6_monotonic_ts", "WITH n AS (SELECT event_id, user_id, (event_id * 7919) % 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT event_id, user_id, max(t - k) OVER (PARTITION BY user_id ORDER BY event_id) + k AS monotonic_ts FROM n")
def w6_monotonic_ts(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", "user_id", ((F.col("event_id") * 7919) % 1000).alias("t"))
    return M.monotonic(e, ["user_id"], "event_id", "t").drop("t")


# Streams over tables


@register("t2_latest_settings", f"WITH {fx.SETTINGS_CHANGES} SELECT key, arg_max(value, (ts, value)) AS value, epoch_us(max(ts)) AS at FROM settings_changes GROUP BY key")
def t2_latest_settings(spark, sf_dir):
    return streams.latest(fx.settings_changes(spark, sf_dir), "key", "value", tie="value").select("key", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@register(
    "t3_debounce",
    f"""WITH {fx.SETTINGS_CHANGES}, s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM settings_changes WHERE field IN ('view', 'click') WINDOW w AS (PARTITION BY key ORDER BY ts, value)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, value) AS session FROM s)
    SELECT key, arg_max(value, (ts, value)) AS value, arg_max(field, (ts, value)) AS field FROM g GROUP BY key, session UNION ALL SELECT key, value, field FROM settings_changes WHERE field NOT IN ('view', 'click')""",
)
def t3_debounce(spark, sf_dir):
    changes = fx.settings_changes(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.debounce(changes, "6 hours", sliders=F.col("field").isin("view", "click")).select("key", "value", "field")


@register(
    "t3_scheduled_runs",
    f"""WITH {fx.SETTINGS_CHANGES}, w AS (SELECT *, CASE WHEN field IN ('view', 'click') THEN INTERVAL 6 HOUR ELSE INTERVAL 0 HOUR END AS wait, lead(ts) OVER (PARTITION BY key ORDER BY ts, value) AS next FROM settings_changes)
    SELECT key, value, field, epoch_us(ts + wait) AS run_us FROM w WHERE next IS NULL OR next > ts + wait""",
)
def t3_scheduled_runs(spark, sf_dir):
    """Changes that are worked on: a slider's waits, another's does not, and the key's next change replaces what waits."""
    changes = fx.settings_changes(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    runs = streams.undisturbed(changes, streams.slider_wait("6 hours", F.col("field").isin("view", "click")))
    return runs.select("key", "value", "field", F.unix_micros("run_at").alias("run_us"))


@register(
    "t2_current_results",
    f"""WITH {fx.METRICS}, w AS (SELECT *, round(ms * 6000000)::BIGINT AS took, lead(epoch_us(ts)) OVER (PARTITION BY key ORDER BY ts, seq) AS next FROM metrics)
    SELECT key, seq, epoch_us(ts) + took AS done_us FROM w WHERE next IS NULL OR next > epoch_us(ts) + took""",
)
def t2_current_results(spark, sf_dir):
    """Results that came before the key's next request; later ones are dropped.  A request takes six seconds a ms."""
    requests = fx.metrics(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    done = streams.undisturbed(requests, F.round(F.col("ms") * 6_000_000).cast("long"), tie="seq")
    return done.select("key", "seq", F.unix_micros("run_at").alias("done_us"))


@register("t5_windowed_timings", f"WITH {fx.METRICS} SELECT name, epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS start_us, count(*) AS n, round(avg(ms), 6) AS average, max(ms) AS max FROM metrics GROUP BY ALL")
def t5_windowed_timings(spark, sf_dir):
    m = fx.metrics(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.windowed_timings(m, "1 day").select("name", F.unix_micros("start").alias("start_us"), "n", F.round("average", 6).alias("average"), "max")
