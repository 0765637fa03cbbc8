"""Golden values, laws and independent slow versions of the pixel operators."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom import schemas
from pixelloom.functions import color, pixel
from pixelloom.operators import diffusion, dither, geometry, job_table, jobs, match, metrics, preview, resize
from pixelloom.operators.dither import Settings
from pixelloom.sources.palettes import Swatch, default_swatches

SMALL = [Swatch(0, "#000000", "free", (0, 0, 0)), Swatch(1, "#FF0000", "free", (255, 0, 0)), Swatch(2, "#FFFFFF", "free", (255, 255, 255)), Swatch(3, "transparent", "transparent", None)]


def image(spark, pixels, width, image_id=0):
    rows = [(image_id, i // width, i % width, *p) for i, p in enumerate(pixels)]
    return spark.createDataFrame(rows, schemas.PIXELS)


def patterned(spark, width, height):
    return image(spark, [((47 * x + 11 * y) & 255, (7 * x + 53 * y) & 255, (19 * x * y + 31) & 255, 96 if (x + y) % 5 == 0 else 255) for y in range(height) for x in range(width)], width)


def pixels(df):
    return [tuple(r[c] for c in "rgba") for r in df.orderBy("y", "x").collect()]


def indices(df):
    return [r["idx"] for r in df.orderBy("image_id", "y", "x").collect()]


def test_bayer_matrices():
    assert pixel.bayer_matrix(2) == [[0, 2], [3, 1]]
    assert pixel.bayer_matrix(4)[1] == [12, 4, 14, 6]
    for n in (2, 4, 8, 16):
        assert sorted(itertools.chain(*pixel.bayer_matrix(n))) == list(range(n * n))


def test_kernels_sum_to_one():
    for kernel in diffusion.KERNELS.values():
        assert sum(w for _, _, w in kernel) == pytest.approx(1)


def test_ties_go_to_the_lowest_ordinal_and_transparent_never_wins(spark):
    px = image(spark, [(0, 0, 0, 255), (250, 250, 250, 255)], 2)
    twice = [Swatch(0, "a", "free", (0, 0, 0)), Swatch(1, "b", "free", (0, 0, 0)), Swatch(2, "t", "transparent", None)]
    for space in schemas.COLOR_SPACES:
        assert indices(match.nearest(px, twice, space)) == [0, 0]


@pytest.mark.parametrize("space", schemas.COLOR_SPACES)
def test_palette_colours_are_their_own_match(spark, space):
    palette = default_swatches()
    visible = [s for s in palette if s.visible]
    px = image(spark, [(*s.rgb, 255) for s in visible], len(visible))
    assert indices(dither.quantize(px, palette, Settings(color_space=space))) == [s.ord for s in visible]


def test_blend_over_matte(spark):
    px = image(spark, [(255, 0, 0, 128)], 1)
    out = px.select(*pixel.blend_matte(tuple(F.col(c) for c in "rgb"), F.col("a"), tuple(F.lit(float(v)) for v in (0, 0, 255)))).first()
    assert tuple(out) == (128, 0, 127)


def test_no_colour_bleeds_from_transparent_pixels(spark):
    assert pixels(resize.resize(image(spark, [(255, 0, 0, 0), (0, 0, 255, 255)], 2), 1, 1, "bilinear")) == [(0, 0, 255, 128)]


@pytest.mark.parametrize("mode", resize.MODES)
def test_solid_images_stay_solid(spark, mode):
    assert set(pixels(resize.resize(image(spark, [(21, 89, 233, 255)] * 28, 7), 5, 3, mode))) == {(21, 89, 233, 255)}


@pytest.mark.parametrize("size", [(11, 8), (5, 3)])
def test_nearest_resize_against_a_plain_loop(spark, size):
    px = patterned(spark, 8, 5)
    source = {(r["y"], r["x"]): tuple(r[c] for c in "rgba") for r in px.collect()}
    at = lambda t, n, m: min(n - 1, max(0, int(np.floor((t + 0.5) * n / m - 0.5 + 0.5))))
    want = [source[at(y, 5, size[1]), at(x, 8, size[0])] for y in range(size[1]) for x in range(size[0])]
    assert pixels(resize.resize(px, *size, "nearest")) == want


def test_lanczos_against_a_plain_loop(spark):
    px = patterned(spark, 8, 5).withColumn("a", F.lit(255))
    source = np.zeros((5, 8, 3))
    for r in px.collect():
        source[r["y"], r["x"]] = [r["r"], r["g"], r["b"]]

    def weights(n, m):
        out = np.zeros((m, n))
        for t in range(m):
            pos = (t + 0.5) * n / m - 0.5
            for k in range(6):
                i = int(np.floor(pos)) - 2 + k
                out[t, min(n - 1, max(0, i))] += np.sinc(pos - i) * np.sinc((pos - i) / 3) if abs(pos - i) < 3 else 0
        return out / out.sum(1, keepdims=True)

    want = np.einsum("ty,yxc,sx->tsc", weights(5, 3), source, weights(8, 5))
    want = np.clip(np.floor(want + 0.5), 0, 255).reshape(-1, 3)
    got = np.array([p[:3] for p in pixels(resize.resize(px, 5, 3, "lanczos3"))])
    assert np.abs(got - want).max() <= 1


def test_content_bounds(spark):
    clear = image(spark, [(0, 0, 0, 0)] * 4, 2)
    assert geometry.content_bounds(clear).first()["x"] is None
    box = image(spark, [(0, 0, 0, 255 if (x, y) in ((1, 1), (2, 1)) else 0) for y in range(3) for x in range(4)], 4)
    assert tuple(geometry.content_bounds(box).first())[1:] == (1, 1, 2, 1)
    assert geometry.content_bounds(image(spark, [(0, 0, 0, 255)] * 4, 2)).first()["x"] is None


def test_output_bounds(spark):
    one = spark.range(1)
    w, h, _ = geometry.fit_to_bounds(F.lit(50000), F.lit(100))
    assert tuple(one.select(w, h).first()) == (16384, 32)


def test_pyramid_ends_at_one_pixel(spark):
    levels = dict(geometry.pyramid(patterned(spark, 5, 3), 2))
    assert [levels[k].count() for k in (0, 1, 2)] == [15, 2, 1]


def serial(values, clear, palette_vectors, ords, kernel, serpentine, strength, masked, as_bytes, unclamped=False):
    """Error diffusion over a whole image in one array."""
    work = values.astype(np.float32)
    height, width, _ = work.shape
    out = np.full((height, width), masked)
    for y in range(height):
        back = serpentine and y % 2 == 1
        for x in range(width - 1, -1, -1) if back else range(width):
            if clear[y, x]:
                continue
            v = raw = work[y, x].astype(float)
            if as_bytes:
                v = np.clip(np.floor(v + 0.5), 0, 255)
            k = int(((v - palette_vectors) ** 2).sum(1).argmin())
            out[y, x] = ords[k]
            error = (raw if unclamped else v) - palette_vectors[k]
            for dx, dy, w in kernel:
                tx, ty = x - dx if back else x + dx, y + dy
                if 0 <= tx < width and ty < height:
                    for c in range(3):
                        work[ty, tx, c] = np.float32(float(work[ty, tx, c]) + error[c] * (w * strength))
    return out.ravel().tolist()


@pytest.mark.parametrize("kernel", list(diffusion.KERNELS))
@pytest.mark.parametrize("in_vectors", [False, True])
@pytest.mark.parametrize("serpentine", [False, True])
def test_diffusion_against_a_serial_scan(spark, kernel, in_vectors, serpentine):
    px = patterned(spark, 13, 9).withColumn("a", F.when((F.col("x") + F.col("y")) % 7 == 0, 0).otherwise(255))
    palette = default_swatches()
    settings = Settings(color_space="linear-rgb" if in_vectors else "srgb", dither=kernel, strength=90, use_color_space=in_vectors, serpentine=serpentine)
    rows = px.orderBy("y", "x").collect()
    rgb = np.array([[r["r"], r["g"], r["b"]] for r in rows], float).reshape(9, 13, 3)
    clear = np.array([r["a"] == 0 for r in rows]).reshape(9, 13)
    vectors = np.array(match.palette_vectors(spark, palette, settings.color_space))
    if in_vectors:
        c = rgb / 255
        rgb = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    want = serial(rgb, clear, vectors, [s.ord for s in palette if s.visible], diffusion.KERNELS[kernel], serpentine, 0.9, 63, not in_vectors)
    assert indices(diffusion.quantize(px, palette, settings)) == want


def test_strength_zero_is_direct(spark):
    px = patterned(spark, 8, 5)
    direct = indices(dither.quantize(px, SMALL, Settings()))
    for name in ("bayer-4", "random", "sierra"):
        assert indices(jobs.quantize(px, SMALL, Settings(dither=name, strength=0))) == direct


@pytest.mark.parametrize("name", ["none", "bayer-8", "random", "floyd-steinberg"])
@pytest.mark.parametrize("placement", ["everywhere", "adaptive"])
def test_partitions_do_not_matter(spark, name, placement):
    px = patterned(spark, 9, 6)
    settings = Settings(dither=name, placement=placement, use_color_space=True, seed=7)
    assert indices(jobs.quantize(px.repartition(1), SMALL, settings)) == indices(jobs.quantize(px.repartition(7), SMALL, settings))


def test_indexed_images_quantize_to_themselves(spark):
    from pixelloom.sources.palettes import default_palette

    px = patterned(spark, 8, 5)
    once = dither.quantize(px, default_swatches(), Settings())
    again = dither.quantize(match.render(once, default_palette(spark)), default_swatches(), Settings())
    assert indices(once) == indices(again)


def test_noise_against_plain_integers(spark):
    def value(seed, k):
        imul = lambda a, b: (a * b) & 0xFFFFFFFF
        s = (seed + imul(k, 0x6D2B79F5)) & 0xFFFFFFFF
        v = imul(s ^ s >> 15, s | 1)
        v ^= (v + imul(v ^ v >> 7, v | 61)) & 0xFFFFFFFF
        return (v ^ v >> 14) / 2**32 - 0.5

    got = [r[0] for r in spark.range(1, 3000).select(pixel.noise(0xC0FFEE42, F.col("id"))).collect()]
    assert got == [value(0xC0FFEE42, k) for k in range(1, 3000)]


def test_empty_image_table(spark):
    none = patterned(spark, 2, 2).where("false")
    assert dither.quantize(none, SMALL, Settings(dither="random")).count() == 0
    assert diffusion.quantize(none, SMALL, Settings(dither="sierra")).count() == 0
    assert resize.resize(none, 3, 3, "area").count() == 0
    assert color.vector(tuple(F.col(c) for c in "rgb"), "oklab") is not None


def test_a_palette_of_only_transparent(spark):
    px = spark.createDataFrame([(1, 0, 0, 1, 2, 3, 255)], "image_id long, y int, x int, r int, g int, b int, a int")
    clear = [s for s in default_swatches() if s.kind == "transparent"]
    for kind in ("none", "bayer-4", "sierra"):
        assert [r["idx"] for r in jobs.quantize(px, clear, Settings(dither=kind)).collect()] == [clear[0].ord]
        with pytest.raises(ValueError, match="no visible colour"):
            jobs.quantize(px, [], Settings(dither=kind))


def test_diffusion_rejects_incomplete_images(spark):
    whole = [(i, y, x, 10 * x, 20 * y, 30, 255) for i in (1, 2) for y in range(3) for x in range(4)]
    schema = "image_id long, y int, x int, r int, g int, b int, a int"
    for missing in (0, 1):
        px = spark.createDataFrame([p for p in whole if p[:2] != (1, missing)] if missing else [p for p in whole if p[:2] not in ((1, 0), (2, 1))], schema)
        with pytest.raises(Exception, match="missing or repeated pixels"):
            jobs.quantize(px, default_swatches(), Settings(dither="floyd-steinberg")).collect()


def test_missing_palettes_keep_their_pixels(spark):
    px = spark.createDataFrame([(1, "a"), (2, "none"), (3, "long")], "r int, palette_name string").selectExpr("*", "0 as g", "0 as b")
    palettes = spark.createDataFrame([("a", 0, 9, 0, 0)] + [("long", i, 255 if i < 256 else 3, 0, 0) for i in range(300)], "palette_name string, ord int, r int, g int, b int")
    assert {r["r"]: r["idx"] for r in match.nearest_by_palette(px, palettes).collect()} == {1: 0, 2: None, 3: 0}


JOBS = "job_id long, image_id long, palette_name string, width int, height int, resize string, crop_x int, crop_y int, crop_width int, crop_height int, alpha_mode string, alpha_threshold int, matte_key string, dither string, strength double, placement string, radius double, threshold double, softness double, serpentine boolean, seed long, use_color_space boolean, color_space string"


def job(job_id, image_id, s, size=(10, 8), mode="bilinear", crop=None, palette="Default"):
    return (job_id, image_id, palette, *size, mode, *(crop or (None,) * 4), s.alpha_mode, 0, "#FFFFFF", s.dither, float(s.strength), s.placement, float(s.radius), 12.0, 8.0, s.serpentine, s.seed, s.use_color_space, s.color_space)


def test_a_table_of_jobs_is_its_cases_one_by_one(spark):
    """Settings as data against a plan for each: every mode, dither family, alpha mode and placement."""
    from pixelloom.plans import fixtures
    from pixelloom.sources.palettes import default_palette

    px = fixtures.px_events(spark, "/root/testdata/sf0.001").where("image_id < 2").cache()
    cases = [
        (0, 10, 8, "bilinear", Settings(color_space="srgb", dither="random", seed=7)),
        (1, 30, 24, "lanczos3-scale-aware", Settings(dither="bayer-4", use_color_space=True, placement="adaptive", alpha_mode="matte")),
        (2, 16, 9, "area", Settings(color_space="oklch", dither="sierra", use_color_space=True, seed=7, placement="adaptive", radius=70)),
        (3, 10, 8, "nearest", Settings(color_space="weighted-rgb", dither="floyd-steinberg", strength=60, alpha_mode="premultiplied", serpentine=False), (3, 2, 16, 14)),
        (4, 10, 8, "bilinear", Settings(color_space="cielab", strength=0, dither="sierra-lite")),
    ]
    table = spark.createDataFrame([job(2 * c[0] + i, i, c[4], c[1:3], c[3], *c[5:]) for c in cases for i in (0, 1)], JOBS)
    done = job_table.process(px, default_palette(spark), table)
    got = {(r["job_id"], r["y"], r["x"]): r["idx"] for r in done.pixels().collect()}
    want = {(2 * c[0] + r["image_id"], r["y"], r["x"]): r["idx"] for c in cases for r in jobs.process(px, default_swatches(), [c]).collect()}
    assert got == want
    counts = done.stage_counts()
    assert counts["pixels"] == len(got) and counts["resized_pixels"] == sum(2 * w * h for w, h in [(10, 8), (30, 24), (16, 9), (10, 8)])  # cases 0 and 4 share a branch


@pytest.mark.parametrize("works", [3, 4096])
def test_cells_of_jobs_lose_nothing(spark, monkeypatch, works):
    """Many small cells, settings of many jobs and of one, images of several bands, against a plan for each case."""
    from pixelloom.sources.palettes import default_palette

    monkeypatch.setattr(job_table, "CELL_WORKS", works)
    monkeypatch.setattr(job_table, "CELL_PIXELS", 1 << 24 if works > 3 else 500)
    monkeypatch.setattr(job_table, "PIECE", 100)
    monkeypatch.setattr(diffusion, "BUNDLE", 2)
    px = patterned(spark, 6, 4).withColumn("image_id", F.explode(F.array(*(F.lit(i) for i in range(7))).cast("array<long>"))).withColumn("r", ((F.col("r") + F.col("image_id") * 31) % 256).cast("int"))
    cases = [
        (0, 5, 130, "bilinear", Settings(dither="bayer-2", use_color_space=True, placement="adaptive", radius=3)),
        (1, 5, 130, "bilinear", Settings(color_space="srgb", dither="random", placement="adaptive", radius=9, alpha_mode="premultiplied")),
        (2, 5, 130, "bilinear", Settings(color_space="srgb", dither="random", seed=7)),
        (3, 10, 8, "nearest", Settings(color_space="srgb", dither="floyd-steinberg", placement="adaptive", radius=2)),
        (4, 10, 8, "area", Settings(dither="sierra-lite", use_color_space=True, serpentine=False)),
    ]
    own = lambda c: (0,) if c[0] == 2 else range(7)
    table = spark.createDataFrame([job(10 * c[0] + i, i, c[4], c[1:3], c[3]) for c in cases for i in own(c)], JOBS)
    got = {(r["job_id"], r["y"], r["x"]): r["idx"] for r in job_table.process(px, default_palette(spark), table).pixels().collect()}
    want = {(10 * c[0] + r["image_id"], r["y"], r["x"]): r["idx"] for c in cases for r in jobs.process(px, default_swatches(), [c]).collect() if r["image_id"] in own(c)}
    assert got == want


def test_rows_of_pixels_are_not_shuffled_for_each_job(spark):
    """The rows of an image go to a cell once, however many jobs with diffusion or noise it has."""
    from pixelloom.sources.palettes import default_palette

    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    table = spark.createDataFrame([job(k, 0, Settings(color_space="srgb", dither=("random", "sierra")[k % 2], seed=k), (10, 40)) for k in range(60)], JOBS)
    done = job_table.process(patterned(spark, 6, 4), default_palette(spark), table)
    before = {s.stageId() for s in stages()}
    rows = done.results.count()
    written = sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)
    assert rows == 60 * 40 and written < rows


def test_jobs_of_equal_settings_are_worked_once(spark):
    from pixelloom.sources.palettes import default_palette

    table = spark.createDataFrame([job(k, 0, Settings(color_space="srgb", seed=k % 2)) for k in range(6)], JOBS)
    done = job_table.process(patterned(spark, 6, 4), default_palette(spark), table)
    assert {(r["job_id"], r["work"]) for r in done.members.collect()} == {(k, k % 2) for k in range(6)}
    rows = {}
    for r in done.rows.collect():
        rows.setdefault(r["job_id"], {})[r["y"]] = tuple(r["idx"])
    assert sorted(rows) == list(range(6)) and len(rows[0]) == 8 and all(v == rows[0] for v in rows.values())


def test_jobs_without_output_have_reasons(spark):
    from pixelloom.sources.palettes import default_palette

    px = patterned(spark, 6, 4)
    clear = spark.createDataFrame([("Clear", 0, "transparent", "n", "transparent", None, None, None, None)], schemas.PALETTE)
    rows = [job(1, 0, Settings(color_space="srgb")), job(2, 0, Settings(strength=-1)), job(3, 9, Settings()), job(4, 0, Settings(), palette="Lost"), job(5, 0, Settings(), mode="cubic"), job(6, 0, Settings(dither="sierra"), palette="Clear"), job(7, 9, Settings(strength=-1), palette="Lost")]
    done = job_table.process(px, default_palette(spark).unionByName(clear), spark.createDataFrame(rows, JOBS))
    reasons = {r["job_id"]: (r["status"], r["reasons"], r["warnings"]) for r in done.outcomes.collect()}
    assert reasons[1] == ("done", [], []) and reasons[6] == ("done", [], ["only Transparent: every pixel is transparent"])
    assert {j: r[1] for j, r in reasons.items() if r[0] == "rejected"} == {2: ["strength"], 3: ["unknown image"], 4: ["unknown palette"], 5: ["resize"], 7: ["strength", "unknown palette", "unknown image"]}
    got = done.pixels().groupBy("job_id").agg(F.count("*").alias("n"), F.max("idx").alias("top")).collect()
    assert {r["job_id"]: r["n"] for r in got} == {1: 80, 6: 80} and {r["top"] for r in got if r["job_id"] == 6} == {0}
    none = job_table.process(px, default_palette(spark), spark.createDataFrame([], JOBS))
    assert none.pixels().count() == none.outcomes.count() == 0


def test_a_replaced_file_makes_its_outputs_stale(spark, tmp_path):
    from pixelloom.sources import images
    from pixelloom.sources.palettes import default_palette

    def write(width):
        (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + width.to_bytes(4, "big") + b"\0\0\0\2" + bytes(20))

    palettes = default_palette(spark)
    write(4)
    files = lambda: images.sources(spark.read.format("binaryFile").load(str(tmp_path)))
    first = files().first()
    assert (first["name"], first["mime"], first["width"], first["height"]) == ("a.png", "image/png", 4, 2)
    table = spark.createDataFrame([job(1, first["image_id"], Settings())], JOBS)
    outputs = jobs.with_identity(table, palettes, sources=files()).select("job_id", "settings_hash").collect()
    outputs = spark.createDataFrame(outputs, "job_id long, settings_hash string")
    assert jobs.pending(jobs.with_identity(table, palettes, sources=files()), outputs).count() == 0
    write(5)
    again = jobs.with_identity(table, palettes, sources=files())
    assert files().first()["image_id"] == first["image_id"]
    assert jobs.pending(again, outputs).count() == 1 and jobs.stale(outputs, again).count() == 1


def test_checksums_of_wide_and_tall_images(spark):
    """Folds of rows and bands against the fold of all indices one by one."""
    rng = np.random.default_rng(5)
    want, rows = {}, []
    for image, (height, width) in enumerate([(1, 1), (130, 3), (3, 300), (64, 2), (65, 1)]):
        idx = rng.integers(0, 256, (height, width))
        h = 2166136261
        for v in idx.ravel().tolist():
            h = (h ^ v + 1) * 16777619 & 0xFFFFFFFF
        want[image] = h
        rows += [(image, y, x, int(idx[y, x])) for y in range(height) for x in range(width)]
    indexed = spark.createDataFrame(rows, schemas.INDEXED).repartition(5)
    assert {r["image_id"]: r["checksum"] for r in metrics.index_checksum(indexed).collect()} == want


def test_distinct_colours_are_counted_in_words_by_hash_aggregates(spark):
    px = patterned(spark, 20, 15).unionByName(patterned(spark, 9, 9).withColumn("image_id", F.lit(7).cast("long")))
    rows = px.collect()
    for bayer in (None, 8):
        found = metrics.unique_colors(px, bayer)
        assert "SortAggregate" not in found._jdf.queryExecution().sparkPlan().toString()
        for r in found.collect():
            own = [p for p in rows if p["image_id"] == r["image_id"]]
            assert r["colors"] == len({(p["r"], p["g"], p["b"]) for p in own})
            assert bayer is None or r["threshold_colors"] == len({(p["y"] % 8, p["x"] % 8, p["r"], p["g"], p["b"]) for p in own})


def test_agreement_opens_rows_that_differ(spark):
    rows = [(i, y, x, (i + y * x) % 5) for i in range(3) for y in range(6) for x in range(7)]
    left = spark.createDataFrame(rows, schemas.INDEXED)
    right = spark.createDataFrame([(i, y, x, v + (i == 1 and y == 2 and x < 3)) for i, y, x, v in rows if (i, y, x) != (2, 5, 6)], schemas.INDEXED)
    got = {r["image_id"]: (r["pixels"], r["same"]) for r in metrics.agreement(left, right).collect()}
    assert got == {0: (42, 42), 1: (42, 39), 2: (42, 41)}


def test_pages_of_distinct_colours(spark):
    px = patterned(spark, 20, 15).withColumn("extra", F.col("x") + 1)
    palette = default_swatches()
    plain = match.nearest(px, palette, "oklab").orderBy("y", "x").collect()
    assert match.nearest_distinct(px, palette, "oklab").orderBy("y", "x").collect() == plain
    joins = match.nearest_distinct(px, palette, "oklab")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joins and "SortMergeJoin" not in joins


def test_comparison_of_dithered_spaces(spark):
    px = patterned(spark, 9, 7)
    settings = Settings(dither="bayer-4")
    a, b = (indices(jobs.quantize(px, SMALL, Settings(dither="bayer-4", color_space=c))) for c in ("srgb", "oklab"))
    row = jobs.compare_spaces(px, SMALL, settings, ["srgb", "oklab"]).first()
    assert (row["pixels"], row["same"]) == (63, sum(x == y for x, y in zip(a, b, strict=True)))


def test_colours_are_dealt_before_words_are_joined(spark):
    """No task of the source holds the words of all its images; colours repeat, some are null."""
    px = spark.createDataFrame([(i % 3, 0, i, None if i % 50 == 7 else i * 7 % 256, i // 40, i % 5 * 40, 255) for i in range(900)], "image_id long, y int, x int, r int, g int, b int, a int")
    found = metrics.unique_colors(px)
    plan = found._jdf.queryExecution().executedPlan().toString()
    first = plan.index("partial_bit_or") if "partial_bit_or" in plan else plan.index("bit_or")
    assert "REPARTITION_BY_NUM" in plan[first:]
    want = {}
    for r in px.where("r is not null").collect():
        want.setdefault(r["image_id"], set()).add((r["r"], r["g"], r["b"]))
    assert {r["image_id"]: r["colors"] for r in found.collect()} == {k: len(v) for k, v in want.items()}


def test_headers_are_read_and_files_written_once(spark, tmp_path):
    from pixelloom.sources import image_files, images

    png = images.encode_png(3, [bytes([0, 1, 1])] * 2, [(1, 2, 3, False), (0, 0, 0, True)])
    files = spark.createDataFrame([(f"{i}-out-3x2.png", bytearray(png)) for i in range(20)], "file string, content binary").repartition(4)
    for _ in range(2):  # a rerun changes nothing
        image_files.write_files(files, str(tmp_path / "out"))
        assert sorted(f.name for f in (tmp_path / "out").iterdir()) == sorted(f"{i}-out-3x2.png" for i in range(20))
    assert all(f.read_bytes() == png for f in (tmp_path / "out").iterdir())
    back = images.read_images(spark, str(tmp_path / "out"))
    assert {(r["width"], r["height"]) for r in back.collect()} == {(3, 2)}
    failing = F.when(F.col("file").startswith("7-"), F.raise_error(F.lit("no content")).cast("binary")).otherwise(F.col("content"))
    for bad, why in ((files.withColumn("file", F.lit("same.png")), "names repeat"), (files.withColumn("content", failing), "no content"), (files.withColumn("file", F.lit("../up.png")), "not a file name")):
        with pytest.raises(Exception, match=why):
            image_files.write_files(bad, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or list((tmp_path / "none").iterdir()) == []

    sources = tmp_path / "in"
    sources.mkdir()
    jpeg = b"\xff\xd8" + b"\xff\xe1\xff\xfe" + bytes(0xFFFC) + b"\xff\xc0\0\x11\x08" + (480).to_bytes(2, "big") + (640).to_bytes(2, "big") + bytes(10)
    for name, data in {"a.png": png + bytes(300_000), "b.jpg": jpeg + bytes(300_000), "c.gif": b"GIF89a" + (7).to_bytes(2, "little") + (8).to_bytes(2, "little") + bytes(9), "d.txt": b"text", "e.webp": b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + b"\x09\0\0\x04\0\0" + bytes(10), "f.png": b"\x89PNG\r\n\x1a\n"}.items():
        (sources / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[-1]: (r["mime"], r["bytes"], r["width"], r["height"], r["reason"]) for r in image_files.admit_files(spark, str(sources)).collect()}
    want = {r["path"].rsplit("/", 1)[-1]: (r["mime"], r["bytes"], r["width"], r["height"], r["reason"]) for r in images.admit(spark.read.format("binaryFile").load(str(sources))).collect() if not r["path"].endswith("f.png")}
    assert {k: v for k, v in got.items() if k != "f.png"} == want and got["f.png"] == ("image/png", 8, None, None, "unreadable size")
    read = {r["path"].rsplit("/", 1)[-1]: r["read"] for r in spark.read.format("image-files").load(str(sources)).collect()}
    assert read["a.png"] == image_files.STEP and read["b.jpg"] < 150_000 < images.HEADER_BYTES


@pytest.mark.parametrize("kernel", list(diffusion.KERNELS))
@pytest.mark.parametrize("serpentine", [False, True])
@pytest.mark.parametrize("copies", [1, 7])
def test_preview_of_diffusion_against_a_serial_scan(spark, kernel, serpentine, copies):
    """Errors of unclamped values; alpha is not looked at.  One image goes by numbers, seven in lockstep."""
    one = patterned(spark, 13, 9).withColumn("a", F.lit(0))
    rgb = np.array([[r["r"], r["g"], r["b"]] for r in one.orderBy("y", "x").collect()], float).reshape(9, 13, 3)
    vectors = np.array([s.rgb for s in SMALL if s.visible], float)
    want = serial(rgb, np.zeros((9, 13), bool), vectors, [s.ord for s in SMALL if s.visible], diffusion.KERNELS[kernel], serpentine, 1.5, 0, True, unclamped=True)
    px = one.withColumn("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    got = preview.sample(px, SMALL, Settings(color_space="srgb", dither=kernel, strength=150, serpentine=serpentine))
    assert [r["idx"] for r in got.orderBy("image_id", "y", "x").collect()] == want * copies
    if not serpentine and kernel == "sierra":
        assert indices(diffusion.quantize(one.withColumn("a", F.lit(255)), SMALL, Settings(color_space="srgb", dither=kernel, strength=150, serpentine=False))) != want


def test_previews_on_the_ramp(spark):
    from pixelloom.sources.images import synth_ramp

    ramp = synth_ramp(spark, 0, 12)
    direct = indices(match.nearest(ramp, default_swatches(), "srgb"))
    for way in ("none", "bayer-4", "random", "sierra"):
        shown = indices(preview.sample(ramp, default_swatches(), Settings(color_space="srgb", dither=way, strength=0)))
        assert shown == direct
    # twice the strength of the quantizer is the preview's, where nothing is transparent
    for way in ("bayer-8", "random"):
        shown = indices(preview.sample(ramp, default_swatches(), Settings(color_space="srgb", dither=way, strength=40)))
        assert shown == indices(dither.quantize(ramp, default_swatches(), Settings(color_space="srgb", dither=way, strength=80)))
    assert preview.sample(ramp.limit(0), default_swatches(), Settings(dither="random")).count() == 0
    with pytest.raises(ValueError):
        preview.sample(ramp, [s for s in default_swatches() if not s.visible], Settings())


def test_jobs_of_one_palette_are_judged_without_a_broadcast_of_jobs(spark):
    """A constant palette name leaves no key to join by; jobs are joined with palettes and images only, never with jobs."""
    from pixelloom.plans import fixtures
    from pixelloom.sources.palettes import default_palette

    asked = fixtures.jobs(spark, "/root/testdata/sf0.001").withColumn("palette_name", F.lit("Default"))
    judged = job_table.outcomes(asked, spark.range(20).withColumnRenamed("id", "image_id"), default_palette(spark))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 2 and "BuildLeft" not in plan
    bad = {r["job_id"]: r["reasons"] for r in jobs.violations(asked).collect()}
    rows = judged.collect()
    assert len(rows) == asked.count() and {r["status"] for r in rows} == {"done", "rejected"}
    for r in rows:
        assert r["reasons"] == bad.get(r["job_id"], []) + ["unknown image"] * (r["image_id"] >= 20)
