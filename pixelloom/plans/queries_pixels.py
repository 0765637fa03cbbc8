"""Registered queries on colours, matching, quantizing and geometry, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom import schemas
from pixelloom.functions import color, pixel
from pixelloom.operators import diffusion, dither, geometry, job_table, jobs, match, metrics, preview, resize
from pixelloom.operators.dither import Settings
from pixelloom.plans import fixtures as fx
from pixelloom.plans import sql
from pixelloom.sources.palettes import default_palette, default_swatches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ("image_id", "y", "x")
PALETTE = default_swatches()


def _rgb() -> tuple:
    return tuple(F.col(c) for c in "rgb")


def register(name: str, oracle: str | None = None):
    def add(query):
        QUERIES[name] = query
        if oracle:
            ORACLE_SQL[name] = oracle
        return query

    return add


def _rid(source: str) -> str:
    return f"{source}_r AS (SELECT image_id * 1000000 + y * 1000 + x AS rid, * FROM {source})"


# Colours


def _vector_query(space: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = color.vector(_rgb(), space)
        return fx.px_events(spark, sf_dir).select(*KEY, *(F.round(c, 7).alias(f"v{k}") for k, c in enumerate(v)))

    v = sql.vector(sql.RGB, space)
    register(f"f7_vector_{space.replace('-', '_')}", f"WITH {fx.PX_EVENTS} SELECT image_id, y, x, {', '.join(f'round({e}, 7) AS v{k}' for k, e in enumerate(v))} FROM px_events")(query)


for _space in schemas.COLOR_SPACES:
    _vector_query(_space)


@register("f1_clamp_byte", f"WITH {fx.PX_EVENTS} SELECT image_id, y, x, {sql.byte('(r - 128) * 3 + g / 7.0::DOUBLE')} AS v FROM px_events")
def f1_clamp_byte(spark, sf_dir):
    return fx.px_events(spark, sf_dir).select(*KEY, color.clamp_byte((F.col("r") - 128) * 3 + F.col("g") / 7.0).alias("v"))


@register(
    "f9_hsv_hsl_round_trip",
    f"""WITH {fx.PX_EVENTS}, m AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS hi, least(r, g, b) / 255.0::DOUBLE AS lo FROM px_events),
    h AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi = r / 255.0::DOUBLE THEN 60 * ((g - b) / 255.0::DOUBLE / (hi - lo)) + CASE WHEN g < b THEN 360 ELSE 0 END WHEN hi = g / 255.0::DOUBLE THEN 60 * ((b - r) / 255.0::DOUBLE / (hi - lo) + 2) ELSE 60 * ((r - g) / 255.0::DOUBLE / (hi - lo) + 4) END AS hue FROM m)
    SELECT image_id, y, x, round(hue, 6) AS hue, round(CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi * 100 END, 6) AS hsv_s, round(hi * 100, 6) AS hsv_v,
        round(CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (1 - abs(hi + lo - 1)) * 100 END, 6) AS hsl_s, round((hi + lo) / 2 * 100, 6) AS hsl_l, r AS r1, g AS g1, b AS b1, r AS r2, g AS g2, b AS b2 FROM h""",
)
def f9_hsv_hsl(spark, sf_dir):
    """To HSV and HSL and back, which gives the bytes again."""
    px = fx.px_events(spark, sf_dir)
    hsv, hsl = color.rgb_to_hsv(_rgb()), color.rgb_to_hsl(_rgb())
    named = px.select(*KEY, *(c.alias(n) for n, c in zip(("hue", "hsv_s", "hsv_v"), hsv, strict=True)), *(c.alias(n) for n, c in zip(("hsl_s", "hsl_l"), hsl[1:], strict=True)))
    back1 = color.hsv_to_rgb(tuple(F.col(c) for c in ("hue", "hsv_s", "hsv_v")))
    back2 = color.hsl_to_rgb(tuple(F.col(c) for c in ("hue", "hsl_s", "hsl_l")))
    return named.select(*KEY, *(F.round(c, 6).alias(c) for c in ("hue", "hsv_s", "hsv_v", "hsl_s", "hsl_l")), *(v.alias(f"{c}1") for c, v in zip("rgb", back1, strict=True)), *(v.alias(f"{c}2") for c, v in zip("rgb", back2, strict=True)))


@register("f9b_oklab_round_trip", f"WITH {fx.PX_EVENTS} SELECT image_id, y, x, r, g, b FROM px_events")
def f9b_oklab_round_trip(spark, sf_dir):
    """Through OKLab, OKLCH in degrees and back."""
    px = fx.px_events(spark, sf_dir)
    lch = color.oklab_to_oklch(color.rgb_to_oklab(_rgb()))
    named = px.select(*KEY, *(c.alias(f"l{k}") for k, c in enumerate(lch)))
    lab = named.select(*KEY, *(c.alias(f"m{k}") for k, c in enumerate(color.oklch_to_oklab(tuple(F.col(f"l{k}") for k in range(3))))))
    return lab.select(*KEY, *(c.alias(n) for n, c in zip("rgb", color.oklab_to_rgb(tuple(F.col(f"m{k}") for k in range(3))), strict=True)))


@register(
    "f12_composite",
    f"""WITH {fx.PX_EVENTS} SELECT image_id, y, x, {', '.join(f'{e} AS p{c}' for c, e in zip('rgb', sql.composite('premultiplied'), strict=True))}, {', '.join(f'{e} AS m{c}' for c, e in zip('rgb', sql.composite('matte'), strict=True))},
    {', '.join(f"CASE WHEN a <= 0 THEN 0 ELSE {sql.byte(f'{c} / (a / 255.0::DOUBLE)')} END AS u{c}" for c in 'rgb')} FROM px_events""",
)
def f12_composite(spark, sf_dir):
    """Premultiplied, over white, and unpremultiplied colours."""
    a = F.col("a")
    pre, over, un = pixel.premultiply(_rgb(), a), pixel.blend_matte(_rgb(), a, (F.lit(255.0),) * 3), pixel.unpremultiply(_rgb(), a)
    return fx.px_events(spark, sf_dir).select(*KEY, *(v.alias(f"{p}{c}") for p, t in (("p", pre), ("m", over), ("u", un[:3])) for c, v in zip("rgb", t, strict=True)))




@register(
    "f13_noise",
    """WITH s AS (SELECT event_id, (7 + ((event_id + 1) & 4294967295) * 1831565813) & 4294967295 AS s FROM events),
    v AS (SELECT event_id, ((xor(s, s >> 15)::HUGEINT * (s | 1)) % 4294967296)::BIGINT AS v FROM s),
    w AS (SELECT event_id, xor(v, (v + ((xor(v, v >> 7)::HUGEINT * (v | 61)) % 4294967296)::BIGINT) & 4294967295) AS w FROM v)
    SELECT event_id, xor(w, w >> 14) / 4294967296.0::DOUBLE - 0.5 AS noise FROM w""",
)
def f13_noise(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", pixel.noise(7, F.col("event_id") + 1).alias("noise"))


def _bayer_sql(n: int) -> str:
    return "[" + ", ".join(str(v) for row in pixel.bayer_matrix(n) for v in row) + f"][(y % {n}) * {n} + x % {n} + 1]"


@register("j4_bayer_lookup", f"WITH {fx.PX_EVENTS} SELECT image_id, y, x, {', '.join(f'({_bayer_sql(n)} + 0.5::DOUBLE) / {n * n} - 0.5::DOUBLE AS t{n}' for n in (2, 4, 8, 16))}, ({_bayer_sql(8)} + 0.5::DOUBLE) / 64 AS u8 FROM px_events")
def j4_bayer_lookup(spark, sf_dir):
    y, x = F.col("y"), F.col("x")
    return fx.px_events(spark, sf_dir).select(*KEY, *(pixel.bayer_threshold(n, y, x).alias(f"t{n}") for n in (2, 4, 8, 16)), pixel.bayer_threshold(8, y, x, centred=False).alias("u8"))


# Matching


def _nearest_query(space: str):
    def query(spark, sf_dir):
        return match.nearest(fx.px_events(spark, sf_dir), PALETTE, space).select(*KEY, "idx")

    register(f"j1_nearest_{space.replace('-', '_')}", f"WITH {fx.PX_EVENTS}, {fx.DEFAULT}, {_rid('px_events')}, {sql.nearest('px_events_r', space)} SELECT image_id, y, x, idx FROM px_events_r JOIN matched USING (rid)")(query)


for _space in schemas.COLOR_SPACES:
    _nearest_query(_space)


def _distinct_sql(source: str, space: str) -> str:
    """CTE matched(r, g, b, idx): the nearest colour of each distinct colour of a CTE."""
    return f"{fx.DEFAULT}, colors AS (SELECT row_number() OVER () AS rid, r, g, b FROM (SELECT DISTINCT r, g, b FROM {source})), {sql.nearest('colors', space, name='by_rid')}, matched AS (SELECT r, g, b, idx FROM colors JOIN by_rid USING (rid))"


@register("j2_nearest_distinct", f"WITH {fx.PX_EMBED}, {_distinct_sql('px_embed', 'oklab')} SELECT image_id, y, x, idx FROM px_embed JOIN matched USING (r, g, b)")
def j2_nearest_distinct(spark, sf_dir):
    return match.nearest_distinct(fx.px_embed(spark, sf_dir), PALETTE, "oklab").select(*KEY, "idx")


_SHIFTED = [f"({e} + 0.01::DOUBLE)" for e in sql.vector(sql.RGB, "oklab")]


@register("j3_nearest_vector", f"WITH {fx.PX_EVENTS}, {fx.DEFAULT}, {_rid('px_events')}, {sql.nearest('px_events_r', 'oklab', vectors=_SHIFTED)} SELECT image_id, y, x, idx FROM px_events_r JOIN matched USING (rid)")
def j3_nearest_vector(spark, sf_dir):
    moved = fx.px_events(spark, sf_dir).withColumns({f"v{k}": v + 0.01 for k, v in enumerate(color.rgb_to_oklab(_rgb()))})
    return match.nearest_vector(moved, PALETTE, "oklab").select(*KEY, "idx")


@register(
    "j1_nearest_by_palette",
    f"""WITH {fx.PX_EVENTS}, {fx.PART_PALETTES}, {_rid('px_events')}, named AS (SELECT *, 'Brand#' || (image_id % 3 + 1) || (x % 5 + 1) AS palette_name FROM px_events_r),
    far AS (SELECT rid, p.ord, (n.r - p.r) * (n.r - p.r) + (n.g - p.g) * (n.g - p.g) + (n.b - p.b) * (n.b - p.b) AS d FROM named n JOIN part_palettes p USING (palette_name) WHERE p.r IS NOT NULL AND p.ord < 256)
    SELECT image_id, y, x, palette_name, idx FROM named LEFT JOIN (SELECT rid, arg_min(ord, (d, ord)) AS idx FROM far GROUP BY rid) USING (rid)""",
)
def j1_nearest_by_palette(spark, sf_dir):
    """Every pixel against the palette of its own row."""
    name = F.concat(F.lit("Brand#"), (F.col("image_id") % 3 + 1).cast("string"), (F.col("x") % 5 + 1).cast("string"))
    return match.nearest_by_palette(fx.px_events(spark, sf_dir).withColumn("palette_name", name), fx.part_palettes(spark, sf_dir)).select(*KEY, "palette_name", "idx")


def _direct_sql(source: str, space: str, mode: str, threshold: int = 0) -> str:
    """CTE quantized(image_id, y, x, idx) of direct quantizing."""
    cte = sql.nearest(f"{source}_r", space, sql.composite(mode))
    masked = f"a <= {threshold}" if mode == "preserve" else "false"
    return f"{fx.DEFAULT}, {_rid(source)}, {cte}, quantized AS (SELECT image_id, y, x, CASE WHEN {masked} THEN 63 ELSE idx END AS idx FROM {source}_r JOIN matched USING (rid))"


def _direct_query(mode: str, space: str, threshold: int):
    def query(spark, sf_dir):
        return dither.quantize(fx.px_events(spark, sf_dir), PALETTE, Settings(color_space=space, alpha_mode=mode, alpha_threshold=threshold))

    register(f"q1_direct_{mode}", f"WITH {fx.PX_EVENTS}, {_direct_sql('px_events', space, mode, threshold)} SELECT image_id, y, x, idx FROM quantized")(query)


for _mode, _space, _threshold in (("preserve", "oklab", 100), ("premultiplied", "cielab", 0), ("matte", "weighted-rgb", 0)):
    _direct_query(_mode, _space, _threshold)


@register("a17_palette_usage", f"WITH {fx.PX_EVENTS}, {_direct_sql('px_events', 'srgb', 'preserve')} SELECT ord, name, (SELECT count(*) FROM quantized WHERE idx = ord) AS pixels FROM pal")
def a17_palette_usage(spark, sf_dir):
    """The flagship: pixels per colour of the default palette."""
    indexed = dither.quantize(fx.px_events(spark, sf_dir), PALETTE, Settings(color_space="srgb"))
    return metrics.palette_usage(indexed, default_palette(spark))


@register("j5_render_rgba", f"WITH {fx.PX_EVENTS}, {_direct_sql('px_events', 'srgb', 'preserve', 100)} SELECT image_id, y, x, idx, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, CASE WHEN kind = 'transparent' THEN 0 ELSE 255 END AS a FROM quantized JOIN pal ON ord = idx")
def j5_render(spark, sf_dir):
    indexed = dither.quantize(fx.px_events(spark, sf_dir), PALETTE, Settings(color_space="srgb", alpha_threshold=100))
    return match.render(indexed, default_palette(spark))


# Dithering


def _bayer_query(n: int, in_vectors: bool):
    space = "oklab" if in_vectors else "srgb"
    settings = Settings(color_space=space, dither=f"bayer-{n}", strength=80, use_color_space=in_vectors)

    def query(spark, sf_dir):
        return dither.quantize(fx.px_events(spark, sf_dir), PALETTE, settings)

    t = f"(({_bayer_sql(n)} + 0.5::DOUBLE) / {n * n} - 0.5::DOUBLE)"
    if in_vectors:
        q = sql.vector(sql.RGB, space)
        ranges = f"ranges AS (SELECT {', '.join(f'max({e}) - min({e}) AS g{k}' for k, e in enumerate(q))} FROM pal WHERE kind <> 'transparent')"
        moved = [f"({e} + {t} * 0.8::DOUBLE * 1.0::DOUBLE * 0.25::DOUBLE * (SELECT g{k} FROM ranges))" for k, e in enumerate(q)]
        cte = f"{ranges}, {_rid('px_events')}, {sql.nearest('px_events_r', space, vectors=moved)}"
    else:
        bytes_ = ", ".join(f"{sql.byte(f'{c} + {t} * (96.0::DOUBLE * 0.8::DOUBLE) * 1.0::DOUBLE')} AS {c}" for c in "rgb")
        cte = f"{_rid('px_events')}, moved AS (SELECT rid, {bytes_} FROM px_events_r), {sql.nearest('moved', space)}"
    register(f"{'q3_bayer_vector' if in_vectors else 'q2_bayer_rgb'}_{n}", f"WITH {fx.PX_EVENTS}, {fx.DEFAULT}, {cte} SELECT image_id, y, x, CASE WHEN a <= 0 THEN 63 ELSE idx END AS idx FROM px_events_r JOIN matched USING (rid)")(query)


for _n in (2, 4, 8, 16):
    _bayer_query(_n, False)
for _n in (4, 8):
    _bayer_query(_n, True)

_STEPS = f"{_rid('px_events')}, steps AS (SELECT *, CASE WHEN a > 0 THEN count(*) FILTER (a > 0) OVER (PARTITION BY image_id ORDER BY y, x) END AS step FROM px_events_r)"
_NOISE = """s1 AS (SELECT *, (3237998146 + step * 1831565813) & 4294967295 AS s FROM steps), s2 AS (SELECT *, ((xor(s, s >> 15)::HUGEINT * (s | 1)) % 4294967296)::BIGINT AS v FROM s1),
    s3 AS (SELECT *, xor(v, (v + ((xor(v, v >> 7)::HUGEINT * (v | 61)) % 4294967296)::BIGINT) & 4294967295) AS w FROM s2), noisy AS (SELECT *, xor(w, w >> 14) / 4294967296.0::DOUBLE - 0.5::DOUBLE AS t FROM s3)"""


@register("w1_random_step", f"WITH {fx.PX_EVENTS}, {_STEPS} SELECT image_id, y, x, step FROM steps")
def w1_random_step(spark, sf_dir):
    return dither.random_steps(fx.px_events(spark, sf_dir), F.col("a") <= 0).select(*KEY, F.col("step").cast("long").alias("step"))


def _random_query(in_vectors: bool):
    space = "oklab" if in_vectors else "srgb"
    settings = Settings(color_space=space, dither="random", strength=50, use_color_space=in_vectors)

    def query(spark, sf_dir):
        return dither.quantize(fx.px_events(spark, sf_dir), PALETTE, settings)

    if in_vectors:
        q = sql.vector(sql.RGB, space)
        ranges = f"ranges AS (SELECT {', '.join(f'max({e}) - min({e}) AS g{k}' for k, e in enumerate(q))} FROM pal WHERE kind <> 'transparent')"
        moved = [f"({e} + coalesce(t, 0) * 0.5::DOUBLE * 0.25::DOUBLE * (SELECT g{k} FROM ranges))" for k, e in enumerate(q)]
        cte = f"{ranges}, {sql.nearest('noisy', space, vectors=moved)}"
    else:
        bytes_ = ", ".join(f"{sql.byte(f'{c} + coalesce(t, 0) * 48.0::DOUBLE')} AS {c}" for c in "rgb")
        cte = f"moved AS (SELECT rid, {bytes_} FROM noisy), {sql.nearest('moved', space)}"
    register(f"{'q5_random_vector' if in_vectors else 'q4_random_rgb'}", f"WITH {fx.PX_EVENTS}, {fx.DEFAULT}, {_STEPS}, {_NOISE}, {cte} SELECT image_id, y, x, CASE WHEN a <= 0 THEN 63 ELSE idx END AS idx FROM px_events_r JOIN matched USING (rid)")(query)


_random_query(False)
_random_query(True)

_RANGES_SRGB = "ranges AS (SELECT sqrt(pow(max(r) - min(r), 2) + pow(max(g) - min(g), 2) + pow(max(b) - min(b), 2)) AS diagonal FROM pal WHERE kind <> 'transparent')"
_ADAPTIVE = f"""offsets(dx, dy) AS (VALUES (-3, 0), (3, 0), (0, -3), (0, 3), (-3, -3), (3, -3), (-3, 3), (3, 3)), {_RANGES_SRGB},
    around AS (SELECT p.image_id, p.y, p.x, sqrt(pow(p.r - q.r, 2) + pow(p.g - q.g, 2) + pow(p.b - q.b, 2)) AS d FROM px_events p, offsets o
        JOIN px_events q ON q.image_id = p.image_id AND q.y = least(19, greatest(0, p.y + dy)) AND q.x = least(24, greatest(0, p.x + dx))),
    varied AS (SELECT image_id, y, x, least(1.0, greatest(0.0, (sum(d) / 8 / (SELECT diagonal FROM ranges) * 100 - 4) / 16)) AS t FROM around GROUP BY ALL),
    masks AS (SELECT image_id, y, x, t * t * (3 - 2 * t) AS mask FROM varied)"""


@register("q6_adaptive_mask", f"WITH {fx.PX_EVENTS}, {fx.DEFAULT}, {_ADAPTIVE} SELECT image_id, y, x, round(mask, 9) AS mask FROM masks")
def q6_adaptive_mask(spark, sf_dir):
    return dither.adaptive_mask(fx.px_events(spark, sf_dir), PALETTE, Settings(color_space="srgb")).select(*KEY, F.round("mask", 9).alias("mask"))


@register("j7_neighbour_join", f"WITH {fx.PX_EVENTS}, {fx.DEFAULT}, {_ADAPTIVE} SELECT image_id, count(*) AS pixels, round(sum(mask), 4) AS total FROM masks GROUP BY image_id")
def j7_neighbour_join(spark, sf_dir):
    masks = dither.adaptive_mask(fx.px_events(spark, sf_dir), PALETTE, Settings(color_space="srgb"))
    return masks.groupBy("image_id").agg(F.count("*").alias("pixels"), F.round(F.sum("mask"), 4).alias("total"))


def _diffusion_query(name: str, settings: Settings):
    @register(name)
    def query(spark, sf_dir):
        return diffusion.quantize(fx.px_events(spark, sf_dir), PALETTE, settings)


for _i, _kernel in enumerate(diffusion.KERNELS):
    _diffusion_query(f"q{7 + _i}_{_kernel.replace('-', '_')}", Settings(color_space="oklab", dither=_kernel))
    _diffusion_query(f"q{10 + _i}_{_kernel.replace('-', '_')}_vector", Settings(color_space="oklab", dither=_kernel, use_color_space=True))

# Geometry and resizing


_BOUNDS = f"""WITH {fx.PX_INSET}, shown AS (SELECT image_id, x, y, a FROM px_inset UNION ALL SELECT image_id + 1000000, x, y, 255 FROM px_events
        UNION ALL SELECT image_id + 2000000, x, y, CASE WHEN x < image_id % 7 OR y > 19 - image_id % 3 THEN 0 ELSE a END FROM px_events),
    box AS (SELECT image_id, min(x) FILTER (a > 0) AS x0, max(x) FILTER (a > 0) AS x1, min(y) FILTER (a > 0) AS y0, max(y) FILTER (a > 0) AS y1, max(x) AS mx, max(y) AS my, min(a) = 0 AS clear FROM shown GROUP BY image_id),
    kept AS (SELECT *, clear AND x0 IS NOT NULL AND (x0 > 0 OR y0 > 0 OR x1 < mx OR y1 < my) AS boxed FROM box)
    SELECT image_id, CASE WHEN boxed THEN x0 END AS x, CASE WHEN boxed THEN y0 END AS y, CASE WHEN boxed THEN x1 - x0 + 1 END AS width, CASE WHEN boxed THEN y1 - y0 + 1 END AS height FROM kept"""


@register("a1_content_bounds", _BOUNDS)
def a1_content_bounds(spark, sf_dir):
    """Inset images have a box; opaque ones have none; others by what their events leave."""
    px = fx.px_events(spark, sf_dir)
    hidden = (F.col("x") < F.col("image_id") % 7) | (F.col("y") > 19 - F.col("image_id") % 3)
    cut = px.withColumn("a", F.when(hidden, 0).otherwise(F.col("a"))).withColumn("image_id", F.col("image_id") + 2000000)
    opaque = fx.px_opaque(spark, sf_dir).withColumn("image_id", F.col("image_id") + 1000000)
    return geometry.content_bounds(fx.px_inset(spark, sf_dir).unionByName(opaque).unionByName(cut))


_CROPPED = "SELECT o_orderkey AS job_id, ((o_orderkey % 37) - 5) + 0.5::DOUBLE AS cx, ((o_orderkey % 29) - 4) + 0.25::DOUBLE AS cy, (o_orderkey % 40)::INT AS cw, (o_orderkey % 23)::INT AS ch FROM orders"


def _crops(spark, sf_dir):
    k = F.col("o_orderkey")
    return fx.table(spark, sf_dir, "orders").select(k.alias("job_id"), ((k % 37) - 5 + 0.5).alias("cx"), ((k % 29) - 4 + 0.25).alias("cy"), (k % 40).cast("int").alias("cw"), (k % 23).cast("int").alias("ch"))


@register("p1_clamp_crop", f"WITH c AS ({_CROPPED}), q AS (SELECT *, greatest(0, least(24, cx)) AS x, greatest(0, least(19, cy)) AS y FROM c) SELECT job_id, x, y, greatest(1, least(25 - x, cw)) AS width, greatest(1, least(20 - y, ch)) AS height FROM q")
def p1_clamp_crop(spark, sf_dir):
    out = geometry.clamp_crop(F.lit(25), F.lit(20), *(F.col(c) for c in ("cx", "cy", "cw", "ch")))
    return _crops(spark, sf_dir).select("job_id", *(v.alias(n) for n, v in zip(("x", "y", "width", "height"), out, strict=True)))


@register("p2_normalize_crop", f"WITH c AS ({_CROPPED}), s AS (SELECT *, greatest(1, least(25, cw)) AS width, greatest(1, least(20, ch)) AS height FROM c) SELECT job_id, greatest(0, least(25 - width, floor(cx + 0.5)))::INT AS x, greatest(0, least(20 - height, floor(cy + 0.5)))::INT AS y, width, height FROM s")
def p2_normalize_crop(spark, sf_dir):
    out = geometry.normalize_crop(F.lit(25), F.lit(20), *(F.col(c) for c in ("cx", "cy", "cw", "ch")))
    return _crops(spark, sf_dir).select("job_id", *(v.alias(n) for n, v in zip(("x", "y", "width", "height"), out, strict=True)))


@register("p3_crop_pixels", f"WITH {fx.PX_EVENTS} SELECT image_id, y - 4 AS y, x - 5 AS x, r, g, b, a FROM px_events WHERE x BETWEEN 5 AND 14 AND y BETWEEN 4 AND 11")
def p3_crop_pixels(spark, sf_dir):
    return geometry.crop_pixels(fx.px_events(spark, sf_dir), 5, 4, 10, 8)


@register("p4_alpha_mask", f"WITH {fx.PX_EVENTS} SELECT image_id, y, x, a <= 96 AS masked FROM px_events")
def p4_alpha_mask(spark, sf_dir):
    return fx.px_events(spark, sf_dir).select(*KEY, pixel.is_transparent(F.col("a"), "preserve", 96).alias("masked"))


@register(
    "r9_output_size",
    """WITH s AS (SELECT o_orderkey AS job_id, ((o_orderkey * 13) % 40000)::DOUBLE / 2 AS w0, ((o_orderkey * 29) % 60000)::DOUBLE / 3 AS h0 FROM orders),
    c AS (SELECT *, greatest(1, least(16384, floor(w0 + 0.5))) AS w, greatest(1, least(16384, floor(h0 + 0.5))) AS h FROM s)
    SELECT job_id, CASE WHEN w * h > 67108864 THEN greatest(1, floor(w * sqrt(67108864.0::DOUBLE / (w * h)))) ELSE w END::INT AS width, CASE WHEN w * h > 67108864 THEN greatest(1, floor(h * sqrt(67108864.0::DOUBLE / (w * h)))) ELSE h END::INT AS height, w * h > 67108864 AS limited FROM c""",
)
def r9_output_size(spark, sf_dir):
    k = F.col("o_orderkey")
    w, h, limited = geometry.output_size(((k * 13) % 40000) / 2, ((k * 29) % 60000) / 3)
    return fx.table(spark, sf_dir, "orders").select(k.alias("job_id"), w.alias("width"), h.alias("height"), limited.alias("limited"))


@register(
    "r10_scale_dims",
    """WITH s AS (SELECT o_orderkey AS job_id, (o_orderkey % 4000 + 1)::INT AS w, ((o_orderkey * 3) % 3000 + 1)::INT AS h, (o_orderkey % 130) / 100.0::DOUBLE AS f FROM orders),
    d AS (SELECT *, greatest(1, floor(w * greatest(0.05, least(1.0, f)) + 0.5))::INT AS width, greatest(1, floor(h * greatest(0.05, least(1.0, f)) + 0.5))::INT AS height FROM s)
    SELECT job_id, width, height, greatest(0.05, least(1.0, CASE WHEN w >= h THEN width / w::DOUBLE ELSE height / h::DOUBLE END)) AS factor FROM d""",
)
def r10_scale_dims(spark, sf_dir):
    k = F.col("o_orderkey")
    s = fx.table(spark, sf_dir, "orders").select(k.alias("job_id"), (k % 4000 + 1).cast("int").alias("w"), ((k * 3) % 3000 + 1).cast("int").alias("h"), ((k % 130) / 100.0).alias("f"))
    width, height = geometry.scaled_size(F.col("w"), F.col("h"), F.col("f"))
    d = s.select("job_id", "w", "h", width.alias("width"), height.alias("height"))
    return d.select("job_id", "width", "height", geometry.factor_of_size(F.col("w"), F.col("h"), F.col("width"), F.col("height")).alias("factor"))


def _taps_sql(name: str, side: int, count: int, mode: str, start: float = 0.0, length: float | None = None) -> str:
    """CTE name(t, s, w) of one axis."""
    scale = (side if length is None else length) / count
    base = f"(SELECT t, {start}::DOUBLE + (t + 0.5) * {scale!r}::DOUBLE - 0.5 AS pos FROM range({count}) q(t))"
    edge = lambda i: f"greatest(0, least({side - 1}, {i}))::INT"
    if mode == "nearest":
        return f"{name} AS (SELECT t, {edge('floor(pos + 0.5)')} AS s, 1.0::DOUBLE AS w FROM {base})"
    if mode == "bilinear":
        return f"{name} AS (SELECT t, {edge('floor(pos) + k')} AS s, CASE k WHEN 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w FROM {base}, range(2) q(k))"
    if mode == "area":
        half = f"{scale!r}::DOUBLE / 2"
        return f"{name} AS (SELECT t, {edge('i')} AS s, 1.0::DOUBLE AS w FROM {base}, range(-{int(scale) + 3}, {side + int(scale) + 3}) q(i) WHERE i BETWEEN floor(pos - {half}) AND ceil(pos + {half}))"
    radius, aware = int(mode[7]), mode.endswith("aware")
    stretch = max(1.0, scale) if aware else 1.0
    n = resize.tap_count(scale if aware else 1.0, radius)
    d = f"((pos - i) / {stretch!r}::DOUBLE)"
    sinc = lambda v: f"(CASE WHEN {v} = 0 THEN 1 ELSE sin({v} * pi()) / ({v} * pi()) END)"
    w = f"CASE WHEN abs({d}) >= {radius} THEN 0 ELSE {sinc(d)} * {sinc(f'({d} / {radius})')} END"
    return f"{name} AS (SELECT t, {edge('i')} AS s, {w} AS w FROM (SELECT *, floor(pos) - {n // 2} + 1 + k AS i FROM {base}, range({n}) q(k)))"


def _resize_sql(source: str, mode: str, width: int, height: int, crop=None, side=(25, 20)) -> str:
    cx, cy = ((0.0, None), (0.0, None)) if crop is None else ((crop[0], crop[2]), (crop[1], crop[3]))
    grows = (side[0] if crop is None else crop[2]) < width and (side[1] if crop is None else crop[3]) < height
    kind = "bilinear" if mode == "area" and grows else mode
    ctes = f"{_taps_sql('tx', side[0], width, kind, *cx)}, {_taps_sql('ty', side[1], height, kind, *cy)}"
    if mode == "nearest":
        return f"{ctes} SELECT image_id, ty.t::INT AS y, tx.t::INT AS x, r, g, b, a FROM {source} p JOIN tx ON tx.s = p.x JOIN ty ON ty.s = p.y"
    separable = mode.startswith("lanczos")
    opaque = "bool_and(a = 255)" if kind == "bilinear" else "false"
    flag = f", flags AS (SELECT image_id, bool_and(a = 255) AS opaque FROM {source} GROUP BY image_id)" if separable else ""
    joined = f"{source} p JOIN tx ON tx.s = p.x JOIN ty ON ty.s = p.y" + (" JOIN flags USING (image_id)" if separable else "")
    return f"""{ctes}{flag}, spread AS (SELECT image_id, ty.t::INT AS y, tx.t::INT AS x, p.r, p.g, p.b, p.a, tx.w * ty.w AS w{", opaque" if separable else ""} FROM {joined}),
        sums AS (SELECT image_id, y, x, {"any_value(opaque)" if separable else opaque} AS opaque, sum(w) AS sw, round(sum(w * a) / sum(w), 9) AS sa, {", ".join(f"round(sum(w * {c}) / sum(w), 9) AS o_{c}, round(sum(w * {c} * (a / 255.0::DOUBLE)) / sum(w), 9) AS p_{c}" for c in "rgb")} FROM spread GROUP BY image_id, y, x)
        SELECT image_id, y, x, {", ".join(f"CASE WHEN opaque THEN {sql.byte(f'o_{c}')} WHEN sa <= 0 THEN 0 ELSE {sql.byte(f'p_{c} / (sa / 255.0::DOUBLE)')} END AS {c}" for c in "rgb")}, CASE WHEN opaque THEN 255 WHEN sa <= 0 THEN 0 ELSE {sql.byte("sa")} END AS a FROM sums"""


def _resize_query(name: str, view: str, mode: str, width: int, height: int, crop=None):
    ctes = {"px_events": fx.PX_EVENTS, "px_opaque": fx.PX_OPAQUE}[view]

    def query(spark, sf_dir):
        return resize.resize(getattr(fx, view)(spark, sf_dir), width, height, mode, crop)

    register(name, f"WITH {ctes}, {_resize_sql(view, mode, width, height, crop)}")(query)


_resize_query("r1_nearest", "px_events", "nearest", 11, 8)
_resize_query("r2_bilinear", "px_events", "bilinear", 11, 9)
_resize_query("r2_bilinear_up", "px_opaque", "bilinear", 40, 33)
_resize_query("r3_area", "px_events", "area", 11, 9)
_resize_query("r3_area_crop", "px_opaque", "area", 7, 5, (1.5, 0.0, 16.0, 11.0))
_resize_query("r4_lanczos2", "px_opaque", "lanczos2", 11, 9)
_resize_query("r5_lanczos3", "px_opaque", "lanczos3", 10, 8)
_resize_query("r5_lanczos3_alpha", "px_events", "lanczos3", 11, 9)
_resize_query("r6_lanczos2_scale_aware", "px_opaque", "lanczos2-scale-aware", 7, 6)
_resize_query("r7_lanczos3_scale_aware", "px_events", "lanczos3-scale-aware", 7, 6)


@register("j6_resample_taps", f"WITH {_taps_sql('taps', 25, 9, 'lanczos3')}, {fx.PX_OPAQUE} SELECT i.image_id, t::INT AS t, s, round(w, 9) AS w FROM taps, (SELECT DISTINCT image_id FROM px_opaque) i")
def j6_resample_taps(spark, sf_dir):
    sizes = geometry.image_sizes(fx.px_opaque(spark, sf_dir))
    return resize.taps(sizes, "width", 9, "lanczos3").select("image_id", "t", "s", F.round("w", 9).alias("w"))


def _half(source: str, name: str, n: int, m: int) -> str:
    """One pyramid step from n[0] x n[1] to m[0] x m[1]."""
    rx, ry = n[0] / m[0], n[1] / m[1]
    cover = lambda v, r: f"floor({v} * {r!r}::DOUBLE)"
    mean = lambda c: f"CASE WHEN sum(a) > 0 THEN round_even(sum({c} * a)::DOUBLE / sum(a), 0) ELSE 0 END::INT AS {c}"
    return f"""{name} AS (SELECT image_id, ty::INT AS y, tx::INT AS x, {", ".join(mean(c) for c in "rgb")}, round_even(sum(a)::DOUBLE / count(*), 0)::INT AS a FROM {source}, range({m[0]}) p(tx), range({m[1]}) q(ty)
        WHERE x >= {cover("tx", rx)} AND x < ceil((tx + 1) * {rx!r}::DOUBLE) AND y >= {cover("ty", ry)} AND y < ceil((ty + 1) * {ry!r}::DOUBLE) GROUP BY image_id, ty, tx)"""


@register("a3_pyramid", f"WITH {fx.PX_EVENTS}, {_half('px_events', 'l1', (25, 20), (12, 10))}, {_half('l1', 'l2', (12, 10), (6, 5))}, {_half('l2', 'l3', (6, 5), (3, 2))} SELECT 1 AS level, * FROM l1 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 3, * FROM l3")
def a3_pyramid(spark, sf_dir):
    out = None
    for level, px in geometry.pyramid(fx.px_events(spark, sf_dir), 3):
        if level:
            part = px.select(F.lit(level).alias("level"), *KEY, "r", "g", "b", "a")
            out = part if out is None else out.unionByName(part)
    return out


@register("l4_pyramid_level", f"WITH {fx.PX_EVENTS}, i AS (SELECT DISTINCT image_id FROM px_events), l(level, width) AS (VALUES (0, 25), (1, 12), (2, 6), (3, 3), (4, 1)) SELECT image_id, coalesce((SELECT arg_min(level, width) FROM l WHERE width >= image_id % 30), 4) AS level FROM i")
def l4_pyramid_level(spark, sf_dir):
    widths = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(w).alias("width")) for k, w in enumerate((25, 12, 6, 3, 1))))
    levels = fx.px_events(spark, sf_dir).select("image_id").distinct().withColumn("l", F.explode(widths)).select("image_id", "l.level", "l.width")
    return geometry.pyramid_level(levels.withColumn("target", F.col("image_id") % 30), F.col("target"))


# Jobs over pixels


@register("a6_unique_colors", f"WITH {fx.PX_EMBED} SELECT image_id, count(DISTINCT (r, g, b)) AS colors FROM px_embed GROUP BY image_id")
def a6_unique_colors(spark, sf_dir):
    return metrics.unique_colors(fx.px_embed(spark, sf_dir))


@register("a6_threshold_colors", f"WITH {fx.PX_EVENTS} SELECT image_id, count(DISTINCT (r, g, b)) AS colors, count(DISTINCT ({_bayer_sql(8)}, r, g, b)) AS threshold_colors FROM px_events GROUP BY image_id")
def a6_threshold_colors(spark, sf_dir):
    """Distinct colours, and distinct pairs of a colour and the threshold of its place."""
    return metrics.unique_colors(fx.px_events(spark, sf_dir), 8)


@register(
    "a7_index_checksum",
    f"""WITH {fx.PX_EVENTS}, {_direct_sql("px_events", "srgb", "preserve")}, listed AS (SELECT image_id, list(idx::BIGINT + 1 ORDER BY y, x) AS p FROM quantized GROUP BY image_id)
    SELECT image_id, list_reduce(list_prepend(2166136261::BIGINT, p), lambda h, e: (xor(h, e) * 16777619) & 4294967295) AS checksum FROM listed""",
)
def a7_index_checksum(spark, sf_dir):
    return metrics.index_checksum(dither.quantize(fx.px_events(spark, sf_dir), PALETTE, Settings(color_space="srgb")))


_TWO = f"{fx.PX_EVENTS}, {fx.DEFAULT}, {_rid('px_events')}, {sql.nearest('px_events_r', 'srgb', name='ma')}, {sql.nearest('px_events_r', 'oklab', name='mb')}"


@register("a8_agreement", f"WITH {_TWO} SELECT image_id, count(*) AS pixels, count(*) FILTER (a <= 0 OR ma.idx = mb.idx) AS same FROM px_events_r JOIN ma USING (rid) JOIN mb USING (rid) GROUP BY image_id")
def a8_agreement(spark, sf_dir):
    px = fx.px_events(spark, sf_dir)
    return metrics.agreement(dither.quantize(px, PALETTE, Settings(color_space="srgb")), dither.quantize(px, PALETTE, Settings(color_space="oklab")))


@register("q16_compare_settings", f"WITH {_TWO} SELECT 'srgb' AS baseline, 'oklab' AS variant, count(*) AS pixels, count(*) FILTER (a <= 0 OR ma.idx = mb.idx) AS same FROM px_events_r JOIN ma USING (rid) JOIN mb USING (rid)")
def q16_compare_settings(spark, sf_dir):
    return jobs.compare_spaces(fx.px_events(spark, sf_dir), PALETTE, Settings(), ["srgb", "oklab"])


@register("q14_process_images")
def q14_process_images(spark, sf_dir):
    """Two sizes, four ways of dithering; jobs of one size share a resize."""
    cases = [("small-direct", 10, 8, "bilinear", Settings(color_space="srgb")), ("small-bayer", 10, 8, "bilinear", Settings(dither="bayer-4", use_color_space=True)), ("wide-random", 16, 8, "lanczos3", Settings(dither="random")), ("wide-floyd", 16, 8, "lanczos3", Settings(dither="floyd-steinberg"))]
    return jobs.process(fx.px_events(spark, sf_dir), PALETTE, cases)


@register("q14_process_jobs")
def q14_process_jobs(spark, sf_dir):
    """Jobs as a table, one for each order, over all images of events: many settings, some invalid, with reasons for jobs without output."""
    k, px = F.col("o_orderkey").cast("long"), fx.px_events(spark, sf_dir)
    images = px.agg(F.max("image_id")).first()[0] + 1
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    every = lambda n, odd, usual: F.when(k % n == 0, F.lit(odd)).otherwise(F.lit(usual))
    crop = {c: F.when(k % 4 == 1, v) for c, v in zip(jobs.CROP_COLUMNS, (3, 2, 16, 14), strict=True)}
    asked = fx.table(spark, sf_dir, "orders").select(
        k.alias("job_id"), F.when(k % 103 == 0, images + 5).otherwise(k % images).alias("image_id"), every(101, "Lost", "Default").alias("palette_name"), pick(10, 16, 25).alias("width"), pick(8, 20).alias("height"), pick("bilinear", "nearest", "area").alias("resize"),
        *(v.alias(c) for c, v in crop.items()), pick("preserve", "matte").alias("alpha_mode"), F.lit(0).alias("alpha_threshold"), F.lit("#FFFFFF").alias("matte_key"), pick("none", "bayer-4", "floyd-steinberg", "random", "sierra").alias("dither"),
        every(97, -1, 100).alias("strength"), pick("everywhere", "adaptive", "everywhere").alias("placement"), F.lit(3).alias("radius"), F.lit(12).alias("threshold"), F.lit(8).alias("softness"), (k % 2 == 0).alias("serpentine"), F.lit(7).alias("seed"),
        (k % 3 == 0).alias("use_color_space"), pick("srgb", "oklab", "linear-rgb").alias("color_space"),
    )
    done = job_table.process(px, default_palette(spark), asked)
    pixels = done.results.select("work", "y", F.posexplode("idx").alias("x", "idx"))
    marks = pixels.groupBy("work").agg(F.count("*").alias("pixels"), F.sum((F.col("idx") + 1) * (F.col("y") * 32 + F.col("x") + 1)).alias("mark"))
    marks = done.members.select("job_id", "work").join(marks, "work")
    return done.outcomes.join(marks, "job_id", "left").select("job_id", "image_id", "status", F.concat_ws(", ", "reasons").alias("reasons"), F.concat_ws(", ", "warnings").alias("warnings"), "pixels", "mark")


@register("q14_case_matrix")
def q14_case_matrix(spark, sf_dir):
    """All 2016 cases of the study over every image, in one plan; a case has one job for each image."""
    px = fx.px_events(spark, sf_dir)
    cases = jobs.case_matrix(spark, images=geometry.image_sizes(px))
    side = lambda c: F.greatest(F.lit(1), F.round(F.col(c) * F.col("scale"))).cast("int")
    asked = cases.select(
        F.concat_ws("/", "image_id", "case_id").alias("job_id"), "image_id", "case_id", F.lit("Default").alias("palette_name"), side("width").alias("width"), side("height").alias("height"), "resize", *(F.lit(None).cast("int").alias(c) for c in jobs.CROP_COLUMNS),
        F.lit("preserve").alias("alpha_mode"), F.lit(0).alias("alpha_threshold"), F.lit("#FFFFFF").alias("matte_key"), "dither", F.lit(100).alias("strength"), F.lit("everywhere").alias("placement"), F.lit(3).alias("radius"), F.lit(12).alias("threshold"), F.lit(8).alias("softness"),
        F.lit(True).alias("serpentine"), F.lit(7).alias("seed"), F.lit(True).alias("use_color_space"), "color_space",
    )
    done = job_table.process(px, default_palette(spark), asked)
    case = F.regexp_replace("job_id", "^[^/]*/", "").alias("case_id")
    sums = done.results.groupBy("work").agg(F.sum(F.size("idx")).alias("pixels"), F.sum(F.aggregate("idx", F.lit(0).cast("long"), lambda total, i: total + i)).alias("total"))
    return done.members.join(sums, "work").groupBy(case).agg(F.count("image_id").alias("images"), F.sum("pixels").alias("pixels"), F.sum("total").alias("total"))


@register(
    "q15_dither_ramp",
    f"WITH {fx.PX_EMBED}, moved AS (SELECT image_id, y, x, {', '.join(f'{sql.byte(f"{c} + (({_bayer_sql(8)} + 0.5::DOUBLE) / 64 - 0.5::DOUBLE) * 192")} AS {c}' for c in 'rgb')} FROM px_embed), {_distinct_sql('moved', 'srgb')} SELECT image_id, y, x, idx FROM moved JOIN matched USING (r, g, b)",
)
def q15_dither_ramp(spark, sf_dir):
    """The ordered preview on grey images."""
    return preview.sample(fx.px_embed(spark, sf_dir), PALETTE, Settings(color_space="srgb", dither="bayer-8"))


def _preview_query(name: str, settings: Settings, steps: str, t: str):
    """A preview on grey images; t is the threshold, less a half, in SQL."""
    if settings.in_vectors:
        q = sql.vector(sql.RGB, settings.color_space)
        moved = [f"({e} + {t} * {settings.strength / 100!r}::DOUBLE * 0.25::DOUBLE * (SELECT g{k} FROM ranges))" for k, e in enumerate(q)]
        cte = f"ranges AS (SELECT {', '.join(f'max({e}) - min({e}) AS g{k}' for k, e in enumerate(q))} FROM pal WHERE kind <> 'transparent'), {sql.nearest('noisy', settings.color_space, vectors=moved)}"
    else:
        bytes_ = ", ".join(f"{sql.byte(f'{c} + {t} * {192 * settings.strength / 100!r}::DOUBLE')} AS {c}" for c in "rgb")
        cte = f"moved AS (SELECT rid, {bytes_} FROM noisy), {sql.nearest('moved', settings.color_space)}"

    def query(spark, sf_dir):
        return preview.sample(fx.px_embed(spark, sf_dir), PALETTE, settings)

    register(name, f"WITH {fx.PX_EMBED}, {fx.DEFAULT}, {steps}, {cte} SELECT image_id, y, x, idx FROM px_embed_r JOIN matched USING (rid)")(query)


_preview_query("q15_preview_random", Settings(color_space="srgb", dither="random", strength=50), f"{_STEPS}, {_NOISE}".replace("px_events", "px_embed"), "t")
_preview_query("q15_preview_vector", Settings(color_space="oklab", dither="bayer-4", strength=80, use_color_space=True), f"{_rid('px_embed')}, noisy AS (SELECT * FROM px_embed_r)", f"(({_bayer_sql(4)} + 0.5::DOUBLE) / 16 - 0.5::DOUBLE)")


@register("q15_preview_diffusion")
def q15_preview_diffusion(spark, sf_dir):
    """The preview of every kernel on grey images: errors of unclamped values."""
    grey, out = fx.px_embed(spark, sf_dir), None
    for kernel in diffusion.KERNELS:
        part = preview.sample(grey, PALETTE, Settings(color_space="srgb", dither=kernel)).select(F.lit(kernel).alias("dither"), *KEY, "idx")
        out = part if out is None else out.unionByName(part)
    return out
