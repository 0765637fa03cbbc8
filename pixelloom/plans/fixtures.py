"""Views of the driver's tables as images, palettes, settings and runs, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.sources.palettes import default_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 25 x 20 pixels, one per 500 events."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    at = F.col("event_id") % 500
    return e.select(
        F.floor(F.col("event_id") / 500).alias("image_id"),
        F.floor(at / 25).cast("int").alias("y"),
        (at % 25).cast("int").alias("x"),
        ((F.col("user_id") * 37 + F.col("event_id")) % 256).cast("int").alias("r"),
        (F.round(F.col("value") * 100).cast("long") % 256).cast("int").alias("g"),
        ((F.col("event_id") * F.col("event_id")) % 251).cast("int").alias("b"),
        F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 96).otherwise(255).alias("a"),
    )


def px_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px_events(spark, sf_dir).withColumn("a", F.lit(255))


def px_inset(spark: SparkSession, sf_dir: str) -> DataFrame:
    outside = (F.col("x") < 3) | (F.col("y") < 2) | (F.col("x") > 21)
    return px_events(spark, sf_dir).withColumn("a", F.when(outside, 0).otherwise(255))


def px_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images of 8 x 8 pixels, one per embedding."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e"))
    grey = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("e").cast("double") * 255 + 128))).cast("int")
    return e.select(F.col("vec_id").alias("image_id"), F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), *(grey.alias(c) for c in "rgb"), F.lit(255).alias("a"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, key, scope_key, name, ms, ts."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string")).alias("key"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("scope_key"), F.col("event_type").alias("name"), F.col("value").cast("double").alias("ms"), "ts")


def settings_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_type").alias("field"), F.col("event_id").alias("value"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("case_id"), F.col("l_linestatus").alias("source_id"), F.col("l_orderkey").alias("iteration"), F.col("l_linenumber").alias("stage"), F.col("l_extendedprice").cast("double").alias("ms"))


def part_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A palette per brand, its colours by part key; some repeat, some palettes are too long at the larger sizes."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part")
    order = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    rgb = ((F.col("p_partkey") * 7) % 256, (F.col("p_size") * 5) % 256, (F.col("p_partkey") * F.col("p_size")) % 256)
    colors = p.select(F.col("p_brand").alias("palette_name"), order.cast("int").alias("ord"), F.col("p_name").alias("name"), *(c.cast("int").alias(n) for n, c in zip("rgb", rgb, strict=True)), "p_size", "p_partkey")
    from pixelloom.functions.text import rgb_to_hex

    clear = F.col("p_size") == 13
    tags = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("warm"))).when(F.col("p_size") % 5 == 0, F.array(F.lit("warm"), F.lit("cold")))
    return colors.select(
        "palette_name", "ord", F.when(clear, F.lit("transparent")).otherwise(rgb_to_hex(F.col("r"), F.col("g"), F.col("b"))).alias("key"), "name", F.when(clear, "transparent").when(F.col("p_size") % 2 == 0, "free").otherwise("premium").alias("kind"), *(F.when(~clear, F.col(c)).alias(c) for c in "rgb"), tags.alias("tags")
    )


def part_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored enabled states: every fourth part's colour is off, and black without a palette name is off."""
    p = part_palettes(spark, sf_dir)
    own = p.where(F.col("ord") % 4 == 0).select("palette_name", "key", F.lit(False).alias("enabled")).distinct()
    legacy = p.where(F.col("ord") % 7 == 3).select(F.lit(None).cast("string").alias("palette_name"), "key", (F.col("r") % 2 == 0).alias("enabled")).groupBy("palette_name", "key").agg(F.min("enabled").alias("enabled"))
    return own.unionByName(legacy)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job per order line of the first lines of an order; some settings are out of range."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("job_id"),
        (k % 50).alias("image_id"),
        F.when(k % 4 == 1, "Default").otherwise(F.concat(F.lit("Brand#"), (k % 3 + 1).cast("string"), (k % 6).cast("string"))).alias("palette_name"),
        ((k % 17000) + 1).cast("int").alias("width"),
        ((k * 7) % 16000 - 3).cast("int").alias("height"),
        F.element_at(F.array(*map(F.lit, ("nearest", "bilinear", "lanczos3", "cubic"))), ((k % 4) + 1).cast("int")).alias("resize"),
        F.element_at(F.array(*map(F.lit, ("preserve", "matte", "premultiplied"))), ((k % 3) + 1).cast("int")).alias("alpha_mode"),
        ((k * 3) % 260).cast("int").alias("alpha_threshold"),
        F.lit("#FFFFFF").alias("matte_key"),
        F.element_at(F.array(*map(F.lit, ("none", "bayer-8", "random", "sierra", "blue"))), ((k % 5) + 1).cast("int")).alias("dither"),
        ((k * 11) % 103 - 2).cast("int").alias("strength"),
        F.lit("everywhere").alias("placement"),
        (k % 40 - 1).cast("int").alias("radius"),
        F.lit(12).alias("threshold"),
        F.lit(8).alias("softness"),
        (k % 2 == 0).alias("serpentine"),
        (k % 9).alias("seed"),
        (k % 2 == 1).alias("use_color_space"),
        F.element_at(F.array(*map(F.lit, ("oklab", "srgb", "weighted-rgb"))), ((k % 3) + 1).cast("int")).alias("color_space"),
        *(F.when(k % 7 == 3, v.cast("int")).alias(c) for c, v in (("crop_x", k % 11), ("crop_y", k % 5), ("crop_width", k % 23), ("crop_height", k % 19 + 1))),
    )


# The same views in DuckDB

PX_EVENTS = """px_events AS (SELECT event_id // 500 AS image_id, ((event_id % 500) // 25)::INT AS y, ((event_id % 500) % 25)::INT AS x,
    ((user_id * 37 + event_id) % 256)::INT AS r, (CAST(round(value * 100) AS BIGINT) % 256)::INT AS g, ((event_id * event_id) % 251)::INT AS b,
    CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 96 ELSE 255 END AS a FROM events)"""
PX_OPAQUE = f"{PX_EVENTS}, px_opaque AS (SELECT * REPLACE (255 AS a) FROM px_events)"
PX_INSET = f"{PX_EVENTS}, px_inset AS (SELECT * REPLACE (CASE WHEN x < 3 OR y < 2 OR x > 21 THEN 0 ELSE 255 END AS a) FROM px_events)"
PX_EMBED = """px_embed AS (SELECT vec_id AS image_id, (p // 8)::INT AS y, (p % 8)::INT AS x, v AS r, v AS g, v AS b, 255 AS a FROM (
    SELECT vec_id, p, least(255, greatest(0, floor(embedding[p + 1]::DOUBLE * 255 + 128)))::INT AS v FROM embeddings, range(64) t(p)))"""
METRICS = "metrics AS (SELECT event_id AS seq, 'k' || (user_id % 7) AS key, 'u' || (user_id % 5) AS scope_key, event_type AS name, value::DOUBLE AS ms, ts FROM events)"
SETTINGS_CHANGES = "settings_changes AS (SELECT user_id AS key, ts, event_type AS field, event_id AS value FROM events)"
RUNS = "runs AS (SELECT l_returnflag AS case_id, l_linestatus AS source_id, l_orderkey AS iteration, l_linenumber AS stage, l_extendedprice::DOUBLE AS ms FROM lineitem)"
PART_PALETTES = """part_palettes AS (SELECT palette_name, ord, CASE WHEN clear THEN 'transparent' ELSE printf('#%02X%02X%02X', r, g, b) END AS key, name,
    CASE WHEN clear THEN 'transparent' WHEN p_size % 2 = 0 THEN 'free' ELSE 'premium' END AS kind, CASE WHEN NOT clear THEN r END AS r, CASE WHEN NOT clear THEN g END AS g, CASE WHEN NOT clear THEN b END AS b,
    CASE WHEN p_size % 3 = 0 THEN ['warm'] WHEN p_size % 5 = 0 THEN ['warm', 'cold'] END AS tags
    FROM (SELECT p_brand AS palette_name, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS ord, p_name AS name, ((p_partkey * 7) % 256)::INT AS r, ((p_size * 5) % 256)::INT AS g, ((p_partkey * p_size) % 256)::INT AS b, p_size, p_size = 13 AS clear FROM part))"""
PART_STATE = f"""{PART_PALETTES}, part_state AS (SELECT DISTINCT palette_name, key, false AS enabled FROM part_palettes WHERE ord % 4 = 0
    UNION ALL SELECT NULL, key, bool_and(r % 2 = 0) FROM part_palettes WHERE ord % 7 = 3 GROUP BY key)"""
STATED = f"""{PART_STATE}, stated AS (SELECT p.*, coalesce(o.enabled, l.enabled, true) AS enabled FROM part_palettes p
    LEFT JOIN part_state o ON o.palette_name = p.palette_name AND o.key = p.key LEFT JOIN part_state l ON l.palette_name IS NULL AND l.key = p.key)"""
_COLORS = ", ".join(f"({o}, '{key}', '{name}', '{kind}', {', '.join('NULL' if v is None else str(v) for v in rgb)})" for _, o, key, name, kind, *rgb, _ in default_rows())
DEFAULT = f"pal AS (SELECT * FROM (VALUES {_COLORS}) t(ord, key, name, kind, r, g, b))"
JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_orderkey % 50 AS image_id, CASE WHEN o_orderkey % 4 = 1 THEN 'Default' ELSE 'Brand#' || (o_orderkey % 3 + 1) || (o_orderkey % 6) END AS palette_name, ((o_orderkey % 17000) + 1)::INT AS width, ((o_orderkey * 7) % 16000 - 3)::INT AS height,
    ['nearest', 'bilinear', 'lanczos3', 'cubic'][(o_orderkey % 4) + 1] AS resize, ['preserve', 'matte', 'premultiplied'][(o_orderkey % 3) + 1] AS alpha_mode, ((o_orderkey * 3) % 260)::INT AS alpha_threshold,
    ['none', 'bayer-8', 'random', 'sierra', 'blue'][(o_orderkey % 5) + 1] AS dither, ((o_orderkey * 11) % 103 - 2)::INT AS strength, (o_orderkey % 40 - 1)::INT AS radius, o_orderkey % 2 = 0 AS serpentine, o_orderkey % 9 AS seed, o_orderkey % 2 = 1 AS use_color_space,
    ['oklab', 'srgb', 'weighted-rgb'][(o_orderkey % 3) + 1] AS color_space,
    CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey % 11 END AS crop_x, CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey % 5 END AS crop_y, CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey % 23 END AS crop_width, CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey % 19 + 1 END AS crop_height FROM orders)"""
