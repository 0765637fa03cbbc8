"""Palettes, jobs, metrics, image files and streams on small literal tables."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pixelloom import schemas
from pixelloom.operators import jobs, metrics, palette
from pixelloom.sources import images, palettes
from pixelloom.streaming import streams


def test_import_rules(spark):
    docs = [
        (" Default ", [("Red", "#ff0000", None, None, None)]),
        ("Custom", [("Red", "#f00", None, None, [" warm ", "warm", ""]), ("", "#00FF00", None, None, None), ("T", "transparent", None, None, None)]),
        ("Twice", [("A", "#112233", None, None, None), ("B", "#112233", None, None, None)]),
        (" Same ", [("A", "#112233", None, None, None)]),
        ("Same", [("A", "#112233", None, None, None)]),
        ("Bad", [("A", "112233", None, None, None)]),
        ("None", []),
    ]
    rows = palettes.parse_palettes(spark.createDataFrame(docs, palettes.IMPORT_SCHEMA)).collect()
    errors = {r["palette_name"]: r["error"] for r in rows}
    assert errors == {"Default": "reserved name", "Custom": None, "Twice": "duplicate color", "Same": "duplicate palette", "Bad": "invalid color", "None": "no colors"}
    custom = sorted((r["ord"], r["key"], r["name"], r["kind"], r["r"], r["tags"]) for r in rows if r["palette_name"] == "Custom")
    assert custom == [(0, "#FF0000", "Red", "custom", 255, ["warm"]), (1, "#00FF00", "Color", "custom", 0, None), (2, "transparent", "T", "transparent", None, None)]


def test_palette_files_round_trip(spark, tmp_path):
    p = palettes.default_palette(spark).withColumn("palette_name", F.lit("Mine"))
    palettes.export_palettes(p).write.json(str(tmp_path / "out"))
    back = palettes.read_palettes(spark, str(tmp_path / "out"))
    assert [r["key"] for r in back.orderBy("ord").collect()] == [k for _, k in palettes.DEFAULT_COLORS]
    assert back.where("error is not null").count() == 0


EDITS = "palette_name string, action string, key string, new_key string, name string"


def test_edits_are_rejected_with_a_reason(spark):
    p = palette.duplicate(palettes.default_palette(spark), "Default", "Copy").unionByName(palettes.default_palette(spark))
    edits = [("Copy", "add", None, "#010203", "New"), ("Copy", "add", None, "#000000", None), ("Copy", "delete", "#123456", None, None), ("Copy", "recolor", "#787878", "nope", None), ("Copy", "paint", "#787878", "#111111", None)]
    edits += [("Copy", "add", None, "#010203", "Twin"), ("Copy", "delete", "transparent", None, None), ("Default", "add", None, "#010203", None), ("None", "delete", "#000000", None, None)]
    edited, rejected = palette.edit(p, spark.createDataFrame(edits, EDITS))
    rows = edited.where("palette_name = 'Copy'").orderBy("ord").collect()
    assert [r["ord"] for r in rows] == list(range(65)) and rows[-1]["key"] == "transparent" and (rows[-2]["key"], rows[-2]["name"]) == ("#010203", "New")
    assert edited.where("palette_name = 'Default'").count() == 64
    assert sorted(r["reason"] for r in rejected.collect()) == ["built-in palette", "duplicate color", "duplicate color", "invalid color", "no such color", "no such palette", "transparent color", "unknown action"]


def test_one_edit_of_a_color_and_at_most_256(spark):
    p = palette.duplicate(palettes.default_palette(spark), "Default", "Copy")
    edits = [("Copy", "recolor", "#787878", "#010101", None), ("Copy", "recolor", "#787878", "#010102", None), ("Copy", "delete", "#000000", None, None), ("Copy", "recolor", "#000000", "#010103", None)]
    edited, rejected = palette.edit(p, spark.createDataFrame(edits, EDITS))
    assert edited.count() == 63 and sorted(r["reason"] for r in rejected.collect()) == ["edited twice", "edited twice"]
    many = spark.createDataFrame([("Copy", "add", None, f"#0102{i:02x}", None) for i in range(200)], EDITS)
    edited, rejected = palette.edit(p, many)
    assert edited.count() == 256 and {(r["reason"], r["new_key"] >= "#0102C0") for r in rejected.collect()} == {("too many colors", True)}


def test_create_and_delete_palettes(spark):
    p = palettes.default_palette(spark)
    both = palette.create(p, spark.createDataFrame([(1, "Default"), (2, "Mine")], "seq long, name string"))
    new = both.where("palette_name != 'Default'").collect()
    assert sorted((r["palette_name"], r["ord"], r["key"]) for r in new) == [("Default 2", 0, "transparent"), ("Mine", 0, "transparent")]
    kept, rejected = palette.delete(both, spark.createDataFrame([("Default",), ("Mine",), ("Nothing",)], "palette_name string"))
    assert {r["palette_name"] for r in kept.collect()} == {"Default", "Default 2"}
    assert {r["palette_name"] for r in rejected.collect()} == {"Default", "Nothing"}


def test_nearest_ranks_are_the_percentiles(spark):
    values = [(k, float(v)) for k in ("a", None) for v in (-1e9, -3, -0.5, 0, 0, 0.5, 3, 3, 3, 1e9, "nan", "inf")] + [("b", None), ("c", 7.0)]
    rows = spark.createDataFrame(values, "k string, ms double")
    shares = {f"q{int(s * 100)}": s for s in (0.01, 0.25, 0.5, 0.75, 0.95, 1.0)}
    got = metrics.nearest_ranks(rows, ["k"], "ms", shares).select("_k.k", *shares)
    want = rows.where("ms is not null").groupBy("k").agg(*(metrics.nearest_rank("ms", s).alias(n) for n, s in shares.items()))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_duplicate_and_violations(spark):
    copy = palette.duplicate(palettes.default_palette(spark), "Default", "Copy")
    assert {r["kind"] for r in copy.collect()} == {"custom", "transparent"}
    assert palette.violations(copy).count() == 0
    bad = copy.withColumn("r", F.when(F.col("ord") == 3, None).otherwise(F.col("r")))
    assert [(r["ord"], r["reason"]) for r in palette.violations(bad).collect()] == [(3, "visible color without rgb")]


def test_nearest_rank_percentiles(spark):
    five = spark.createDataFrame([(float(v),) for v in range(1, 6)], "ms double")
    assert five.agg(metrics.nearest_rank("ms", 0.95)).first()[0] == 5
    assert five.agg(metrics.nearest_rank("ms", 0.5)).first()[0] == 3


def test_history_keeps_the_last_hundred_of_a_scope(spark):
    rows = spark.range(105).select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.lit("a").alias("scope_key"), F.lit(1.0).alias("ms"))
    assert sorted(r["seq"] for r in metrics.scoped_history(rows, ["key"]).collect()) == list(range(5, 105))
    changed = rows.unionByName(rows.limit(1).withColumns({"seq": F.lit(200).cast("long"), "scope_key": F.lit("b")}))
    assert [r["seq"] for r in metrics.scoped_history(changed, ["key"]).collect()] == [200]


def test_memory_estimate(spark):
    job = spark.createDataFrame([(1, 20, 10, 10, 10, "floyd-steinberg", True)], "job_id int, source_width int, source_height int, out_width int, out_height int, dither string, in_vectors boolean")
    assert tuple(metrics.memory_estimate(job).first())[1:] == (800, 400, 100, 1200, 1200)


def test_run_stats_of_equal_values(spark):
    r = metrics.run_stats(spark.createDataFrame([("a", 0.0), ("a", 0.0)], "k string, ms double"), ["k"]).first()
    assert (r["cv"], r["outliers"]) == (0, 0)


PALETTES = "palette_name string, ord int, key string, kind string, r int, g int, b int"


def test_job_identity_ignores_column_order_and_follows_palette_and_crop(spark):
    from pixelloom.plans import fixtures

    rows = [("Default", 0, "#000000", "free", 0, 0, 0), ("Default", 1, "transparent", "transparent", None, None, None)]
    palettes = spark.createDataFrame(rows, PALETTES)
    edited = spark.createDataFrame([(*rows[0][:2], "#000001", "free", 0, 0, 1), rows[1]], PALETTES)
    j = fixtures.jobs(spark, "/root/testdata/sf0.001").where("job_id % 4 = 1").limit(5)
    ids = lambda jobs_, colors, *columns: {r["job_id"]: r["settings_hash"] for r in jobs.with_identity(jobs_, colors, *columns).collect()}
    first = ids(j, palettes)
    assert first == ids(j, palettes, jobs.JOB_COLUMNS[::-1]) and len(set(first.values())) == 5
    for changed in (ids(j, edited), ids(j.withColumn("crop_x", F.lit(9)), palettes)):
        assert not set(changed.values()) & set(first.values())
    outputs = jobs.with_identity(j, palettes).select("job_id", "settings_hash")
    assert jobs.stale(outputs, jobs.with_identity(j, edited)).count() == 5 and jobs.pending(jobs.with_identity(j, edited), outputs).count() == 5
    with pytest.raises(Exception, match="strength is not finite"):
        jobs.with_identity(j.withColumn("strength", F.lit(float("nan"))), palettes).collect()


def test_identities_of_long_palettes_do_not_carry_the_colours_by_job(spark):
    """The plain hash of one JSON text, of a palette of several pieces, a missing one and no name; no job is joined with a palette."""
    import hashlib
    import json

    from pixelloom.plans import fixtures

    colors = [("Long", 3 * i, f"#{i:06X}", "free", 0, i // 256, i % 256) for i in range(700)] + [("Long", 9000, "transparent", "transparent", None, None, None)]
    j = fixtures.jobs(spark, "/root/testdata/sf0.001").limit(40).withColumn("palette_name", F.when(F.col("job_id") % 3 == 0, "Long").when(F.col("job_id") % 3 == 1, "Lost"))
    found = jobs.with_identity(j, spark.createDataFrame(colors[::-1], PALETTES))
    assert "Join LeftOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
    own = [{"key": key, "kind": kind, "rgb": None if r is None else {"r": r, "g": g, "b": b}} for _, _, key, kind, r, g, b in colors]
    rows = found.collect()
    assert len(rows) == 40 and {r["palette_name"] for r in rows} == {"Long", "Lost", None}
    for r in rows:
        fields = {c: r[c] for c in ("image_id", "palette_name", *jobs.JOB_COLUMNS)} | {"colors": own if r["palette_name"] == "Long" else None}
        assert r["settings_hash"] == hashlib.sha256(json.dumps(dict(sorted(fields.items())), separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize("query", ["j11_pending_jobs", "j12_exportable_outputs", "j12_stale_outputs", "t6_exactly_once"])
def test_outputs_and_jobs_are_identified_once_each(spark, query):
    from pixelloom.plans import queries_tables

    plan = queries_tables.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join LeftOuter" not in plan


@pytest.mark.parametrize("query", ["j12_exportable_outputs", "j12_stale_outputs", "t6_exactly_once"])
def test_identities_carry_no_settings_through_python(spark, query):
    import re

    from pixelloom.plans import queries_tables

    plan = queries_tables.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"MapInArrow .*\[job_id#\d+L?, settings_hash#\d+\]", plan)) == 2


@pytest.mark.parametrize("query", ["j11_pending_jobs", "j12_exportable_outputs", "j12_stale_outputs", "t6_exactly_once"])
def test_jobs_are_identified_once_for_both_sides(spark, query):
    """The other side of the join reads the exchange of the first, under Spark's reuse of equal exchanges."""
    from pixelloom.plans import queries_tables

    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        plan = queries_tables.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("MapInArrow") == 1


def test_jobs_pass_no_json_writer_and_no_join_to_be_done_once(spark):
    """The texts of jobs are put together from columns, and both sides of t6_exactly_once meet in one aggregation."""
    from pixelloom.plans import queries_tables

    plan = queries_tables.QUERIES["t6_exactly_once"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" not in plan and "alpha_mode" in plan
    assert not [line for line in plan.splitlines() if "StructsToJson" in line and "alpha_mode" in line]


def test_identities_go_to_python_as_flat_columns(spark):
    from pixelloom.plans import fixtures

    j = fixtures.jobs(spark, "/root/testdata/sf0.001")
    plan = jobs.with_identity(j, spark.createDataFrame([], PALETTES))._jdf.queryExecution().analyzed()
    assert plan.nodeName() == "MapInArrow" and "STRUCT" not in plan.children().head().schema().toDDL().upper()


def test_identities_are_the_hash_of_what_the_json_writer_writes(spark):
    """Quotes, control characters, other scripts, nulls and numbers of every kind, before and after the colours."""
    from pixelloom.functions import text

    words = ['a"b', "back\\slash", "\\u001f", "\x00\x01\x1f\x7f", "\b\t\n\f\r", "é 漢 😀 \u2028", "", " ", "null", None, "/", "\ud7ff\ue000"]
    rows = [(n, n % 3, "Lost", w, n if n % 4 else None, [None, True, False][n % 3], [0.0, -0.0, 1e20, 1.5, None][n % 5], [-(1 << 63), (1 << 63) - 1, None][n % 3], w) for n, w in enumerate(words * 2)]
    columns = ("alpha_mode", "alpha_threshold", "serpentine", "strength", "seed", "resize")
    j = spark.createDataFrame(rows, "job_id long, image_id long, palette_name string, alpha_mode string, alpha_threshold int, serpentine boolean, strength double, seed long, resize string")
    j = j.withColumn("blur", F.col("strength").cast("float"))
    columns = (*columns, "blur")
    want = j.select("job_id", text.identity({c: F.col(c) for c in ("image_id", "palette_name", *columns)} | {"colors": F.lit(None).cast("string")}).alias("settings_hash"))
    got = jobs.with_identity(j, spark.createDataFrame([], PALETTES), columns, keep=["job_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_each_identity_is_worked_once(spark):
    """Against the plain join, with repeated identities and nulls on both sides."""
    arriving = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c"), (6, None), (7, None)], "job_id long, settings_hash string")
    done = spark.createDataFrame([("b", 1), ("b", 2), ("x", 3), (None, 4)], "settings_hash string, job_id long")
    found = streams.exactly_once(arriving, done)
    rows = {r["settings_hash"]: r["job_id"] for r in found.collect()}
    assert found.columns == ["settings_hash", "job_id"] and found.count() == 3
    assert set(rows) == {"a", "c", None} and rows["a"] in (1, 2) and rows["c"] in (4, 5) and rows[None] in (6, 7)


@pytest.mark.parametrize("rows", [97, 10_000])
def test_identities_of_batches_that_end_within_a_palette(spark, rows):
    """Groups, heads and pieces that batches of Arrow divide, and palettes without a name."""
    from pixelloom.plans import fixtures

    colors = spark.createDataFrame([(n, i, f"#{i:06X}", "free", 0, i // 256, i % 256) for n in ("A", "B") for i in range(400)], PALETTES)
    j = fixtures.jobs(spark, "/root/testdata/sf0.001").where("job_id < 500").withColumn("palette_name", F.when(F.col("job_id") % 3 == 0, "A").when(F.col("job_id") % 3 == 1, "B"))
    want = {(r["job_id"], r["settings_hash"]) for r in jobs.with_identity(j, colors).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = jobs.with_identity(j, colors, keep=["job_id"])
        assert got.columns == ["job_id", "settings_hash"] and {tuple(r) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_inherited_states_are_those_of_the_nearest_colours(spark):
    """Dense and sparse palettes, ties and empty cubes against all pairs; pairs are not sorted."""
    import random

    rng, schema = random.Random(3), "palette_name string, ord int, key string, name string, kind string, r int, g int, b int, tags array<string>"

    def colors(name, n, low, high):
        found = [[rng.randint(low, high) for _ in "rgb"] for _ in range(n)]
        return [(name, i, f"{name}{'#%02X%02X%02X' % tuple(c)}", "x", "free", *c, None) for i, c in enumerate(found)]

    held = colors("dense", 300, 0, 40) + colors("few", 3, 200, 255) + colors("far", 40, 0, 20)
    wanted = [(*r[:2], "new" + r[2], *r[3:]) for r in colors("dense", 150, 0, 50) + colors("few", 60, 0, 255) + colors("far", 60, 150, 255) + colors("none", 2, 0, 255)]
    state = [(r[0], r[2], False) for r in {r[2]: r for r in held}.values() if rng.random() < 0.5]
    found = palette.inherit_state(spark.createDataFrame(wanted, schema), spark.createDataFrame(held, schema), spark.createDataFrame(state, "palette_name string, key string, enabled boolean"))
    assert "SortAggregate" not in found._jdf.queryExecution().sparkPlan().toString()
    off = {k for _, k, _ in state}
    near = lambda w: min(((sum((w[5 + c] - h[5 + c]) ** 2 for c in range(3)), h[1], h[2] not in off) for h in held if h[0] == w[0]), default=(0, 0, True))[2]
    assert {(r["palette_name"], r["key"]): r["enabled"] for r in found.collect()} == {(w[0], w[2]): near(w) for w in wanted}


def test_job_violations_and_branches(spark):
    from pixelloom.plans import fixtures

    base = fixtures.jobs(spark, "/root/testdata/sf0.001").where("job_id = 4").drop("job_id")
    good = base.withColumns({"height": F.lit(5), "width": F.lit(5), "resize": F.lit("area"), "dither": F.lit("none"), "strength": F.lit(250.0), "radius": F.lit(0.5)})
    cases = {
        1: {},
        2: {"crop_x": F.lit(1.5), "crop_y": F.lit(0.0), "crop_width": F.lit(5), "crop_height": F.lit(5)},
        3: {"crop_x": F.lit(1.5), "crop_y": F.lit(0.0), "crop_width": F.lit(5.5), "crop_height": F.lit(5)},
        4: {"crop_x": F.lit(1.5)},
        5: {"softness": F.lit(float("inf")), "matte_key": F.lit(None).cast("string")},
        6: {"threshold": F.lit(-1)},
    }
    found = {}
    for n, changes in cases.items():
        one = good.withColumns(changes).withColumn("job_id", F.lit(n))
        found[n] = [r["reasons"] for r in jobs.violations(one).collect()]
    assert found == {1: [], 2: [], 3: [["crop"]], 4: [["crop"]], 5: [["softness", "matte_key"]], 6: [["threshold"]]}
    keys = [good.withColumns(cases[n]).select(jobs.branch_key(F.lit(0))).first()[0] for n in (1, 2)]
    assert keys == ["4|5x5|area|0,0,full,full", "4|5x5|area|1.5,0.0,5,5"]


def test_job_warnings(spark):
    rows = [("long", i, "#000000", "free", 0, 0, 0) for i in range(300)] + [("clear", 0, "transparent", "transparent", None, None, None)]
    j = spark.createDataFrame([(1, "long", "preserve"), (2, "long", "matte"), (3, "clear", "preserve"), (4, "none", "preserve")], "job_id int, palette_name string, alpha_mode string")
    got = {r["job_id"]: r["warnings"] for r in jobs.warnings(j, spark.createDataFrame(rows, PALETTES)).collect()}
    assert got == {1: ["palette truncated to 256 colors", "no Transparent: masked pixels take the darkest color"], 2: ["palette truncated to 256 colors"], 3: ["only Transparent: every pixel is transparent"], 4: ["error: no color"]}


def test_formats(spark):
    from pixelloom.functions import text

    values = [(0.0,), (0.05,), (0.1,), (0.456,), (1.0,)]
    assert [r[0] for r in spark.createDataFrame(values, "v double").coalesce(1).select(text.format_percent(F.col("v"))).collect()] == ["0%", "5.00%", "10.0%", "45.6%", "100.0%"]
    values = [(0,), (999,), (1500,), (999_600,), (1_250_000,)]
    got = spark.createDataFrame(values, "v long").coalesce(1).select(text.format_count(F.col("v")), text.format_pixels(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("0", "0"), ("999", "999"), ("2K", "2K"), ("1000K", "1000K"), ("1.3M", "1.3MP")]
    assert [r[0] for r in spark.createDataFrame([(3.14,), (250.6,)], "v double").coalesce(1).select(text.format_stage_ms(F.col("v"))).collect()] == ["3.1ms", "251ms"]


def test_bytes_are_formatted_for_every_order_and_halves_go_up(spark):
    from pixelloom.functions import text
    from pixelloom.plans import registry

    sf = "/root/testdata/sf0.001"
    assert registry.QUERIES["f20_format_bytes_all"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    sizes = {1023: "1023 B", 2304: "2.3 KiB", 10752: "11 KiB", 2359296: "2.3 MiB", 13107200: "13 MiB", 10239: "10.0 KiB"}
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", text.format_bytes(F.col("n")).alias("size"))
    assert {r["n"]: r["size"] for r in got.collect()} == sizes


def test_case_matrix(spark):
    assert jobs.case_matrix(spark).count() == 2016


# Image files


def png(width, height, rows=None):
    header = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows or b"")) + chunk(b"IEND", b"")


def test_admission(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 7, 9) + b"\x01\x01\x11\x00"
    webp = b"RIFF\x00\x00\x00\x00WEBPVP8X\x0a\x00\x00\x00\x00\x00\x00\x00" + (4).to_bytes(3, "little") + (6).to_bytes(3, "little")
    files = {"png": png(3, 2), "gif": b"GIF89a" + struct.pack("<HH", 5, 4) + b"\0" * 6, "jpg": jpeg, "webp": webp, "txt": b"hello world, no image", "wide": png(40000, 2), "big": png(20000, 20000), "cut": png(3, 2)[:14]}
    table = spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in files.items()], "path string, length long, content binary")
    got = {r["path"]: (r["width"], r["height"], r["reason"]) for r in images.admit(table).collect()}
    assert got["png"] == (3, 2, None) and got["gif"] == (5, 4, None) and got["jpg"] == (9, 7, None)
    assert got["webp"] == (5, 7, "no decoder") and got["txt"][2] == "unsupported type"
    assert got["wide"][2] == "side too long" and got["big"][2] == "too many pixels" and got["cut"][2] == "unreadable size"


@pytest.fixture
def folder(tmp_path):
    raw = b"".join(b"\0" + bytes(v for x in range(3) for v in (10 * x + y, 20, 30, 255 if x else 0)) for y in range(2))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(3, 2, raw))
    return tmp_path


def test_read_and_explode(spark, folder):
    px = images.explode_pixels(images.read_images(spark, str(folder / "in")))
    assert sorted((r["y"], r["x"], r["r"], r["g"], r["b"], r["a"]) for r in px.collect()) == [(y, x, 10 * x + y, 20, 30, 255 if x else 0) for y in range(2) for x in range(3)]


def test_export_png_is_read_back(spark, tmp_path):
    px = spark.createDataFrame([(1, y, x, (x + y) % 3) for y in range(4) for x in range(5)], schemas.INDEXED)
    colors = [(255, 0, 0, False), (0, 255, 0, False), (0, 0, 0, True)]
    made = images.export_png(images.pack_rows(px), colors).first()["content"]
    assert bytes(made) == bytes(images.export_png(images.pack_rows(px.repartition(5)), colors).first()["content"])
    (tmp_path / "x.png").write_bytes(bytes(made))
    back = images.explode_pixels(images.read_images(spark, str(tmp_path)))
    assert {(r["y"], r["x"]): (r["r"], r["g"], r["b"], r["a"]) for r in back.collect()} == {(y, x): (*colors[(x + y) % 3][:3], 0 if (x + y) % 3 == 2 else 255) for y in range(4) for x in range(5)}
    assert images.unpack_rows(images.pack_rows(px)).exceptAll(px).count() == 0


def test_synthetic_images(spark):
    first = lambda df, y, x: tuple(df.where((F.col("y") == y) & (F.col("x") == x)).select(*"rgba").first())
    assert first(images.synth_gradient(spark, 1, 5, 5), 0, 4) == (255, 0, 0, 255)
    assert first(images.synth_alpha(spark, 1, 10, 10), 5, 5)[3] == 0
    ramp = images.synth_ramp(spark, 1, 11)
    assert first(ramp, 10, 0)[:3] == (0, 0, 0) and first(ramp, 0, 10)[:3] == (255, 255, 255) and first(ramp, 5, 5)[0] == 119
    assert images.name_seed("photoish") == images.name_seed("photoish") != images.name_seed("memory-pressure")
    assert images.synth_photo(spark, 1, 31, 2).where("a = 96").count() == 2


# Streams


def test_stream_of_images(spark, folder):
    seen = []
    query = streams.stream_images(spark, str(folder / "in"), lambda px, n: seen.append(px.count()), str(folder / "checkpoint"))
    query.awaitTermination(60)
    assert sum(seen) == 6


def _run(frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_latest_and_windows_on_a_stream(spark, tmp_path):
    from pixelloom.plans import fixtures

    events = fixtures.table(spark, "/root/testdata/sf0.001", "events")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    changes = stream.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("value"))
    _run(streams.latest(changes, "key", "value", tie="value"), "latest", "complete")
    batch = streams.latest(fixtures.settings_changes(spark, "/root/testdata/sf0.001"), "key", "value", tie="value")
    assert spark.table("latest").exceptAll(batch).count() == 0
    timed = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), F.col("value").alias("ms"))
    _run(streams.windowed_timings(timed, "1 day", watermark="1 hour"), "windows", "complete")
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_once_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "settings_hash string, s long").select("settings_hash", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(str(tmp_path / "h"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "h"))
    _run(streams.exactly_once_stream(stream, "ts", "1 hour"), "once", "append")
    assert sorted(r[0] for r in spark.table("once").select("settings_hash").collect()) == ["a", "b"]


def test_debounce_on_a_table(spark):
    rows = [("k", 0.0, "strength", 1), ("k", 0.1, "strength", 2), ("k", 5.0, "strength", 3), ("k", 5.05, "resize", 4)]
    df = spark.createDataFrame(rows, "key string, s double, field string, value long").select("key", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "field", "value")
    assert sorted(r["value"] for r in streams.debounce(df, "180 milliseconds").collect()) == [2, 3, 4]


CHANGES = "key string, s double, field string, value long"


def _changes(spark, rows):
    return spark.createDataFrame(rows, CHANGES).select("key", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long")).alias("ts"), "field", "value")


def test_changes_replace_what_waits(spark, small_partitions):
    rows = [
        ("k", 0.0, "strength", 1), ("k", 0.1, "width", 2), ("k", 5.0, "strength", 3), ("k", 5.05, "resize", 4),  # 1 by 2, 3 by 4
        ("k", 9.0, "radius", 5), ("k", 9.18, "radius", 6), ("k", 20.0, "resize", 7), ("k", 20.0, "dither", 8), (None, 1.0, "strength", 9), ("k", None, "resize", 10), ("z", 9.1, "resize", None),
    ]
    got = streams.undisturbed(_changes(spark, [*rows, rows[6], rows[6]]), streams.slider_wait())
    assert sorted((r["value"] or 0, round(r["run_at"].timestamp() * 1000)) for r in got.collect()) == [(0, 9100), (2, 280), (4, 5050), (6, 9360), (8, 20000), (9, 1180)]
    assert streams.undisturbed(_changes(spark, rows).limit(0), streams.slider_wait()).count() == 0


def test_one_key_is_scheduled_over_ranges(spark, small_partitions):
    rows = spark.range(4000).select(F.lit("k").alias("key"), F.timestamp_millis(F.col("id") * 90 + F.pmod(F.xxhash64("id"), F.lit(400))).alias("ts"), F.when(F.col("id") % 3 == 0, "resize").otherwise("strength").alias("field"), F.col("id").alias("value"))
    plain = sorted((r["ts"], r["value"], r["field"]) for r in rows.collect())
    wait = lambda field: 0.18 if field == "strength" else 0.0
    want = [v for (t, v, f), after in zip(plain, [*plain[1:], None], strict=True) if after is None or (after[0] - t).total_seconds() > wait(f)]
    assert sorted(r["value"] for r in streams.undisturbed(rows, streams.slider_wait()).collect()) == sorted(want)


def test_scheduled_changes_on_a_stream(spark, tmp_path):
    """Batches out of order: replaced rows never come out, late rows are dropped, keys without waiting rows leave no state."""
    pytest.importorskip("google.protobuf")
    batches = [
        [("k", 10.0, "strength", 1), ("k", 10.1, "strength", 2), ("m", 10.0, "resize", 3), ("k", 12.0, "strength", 4)],
        [("k", 12.1, "resize", 5), ("k", 11.0, "radius", 6), ("k", 11.05, "width", 7), (None, 13.0, "strength", None)],  # 6 and 7 are earlier than 4, and not late
        [("k", 30.0, "strength", 8), ("z", 30.0, "resize", 9)],
        [("k", 10.55, "resize", 11), ("m", 30.0, "resize", 14)],  # 11 comes before its watermark is in force
        [("q", 90.0, "resize", 12), ("k", 10.05, "resize", 10)],  # 10 is late
        [("q", 200.0, "strength", 13)],
    ]
    for rows in batches:
        _changes(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(_changes(spark, []).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = streams.undisturbed_stream(stream, streams.slider_wait(), "5 seconds").writeStream.format("memory").queryName("scheduled").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    kept = [r for rows in batches for r in rows if r[3] != 10]
    want = {(r["key"], r["value"], r["ts"], r["run_at"]) for r in streams.undisturbed(_changes(spark, kept), streams.slider_wait()).collect() if r["value"] != 13}
    got = [(r["key"], r["value"], r["ts"], r["run_at"]) for r in spark.table("scheduled").collect()]
    assert set(got) == want and len(got) == len(want)
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress)
    assert dropped == 1


def test_rolling_timings_on_a_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = spark.range(130).select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.when(F.col("id") < 10, "a").otherwise("b").alias("scope_key"), F.col("id").cast("double").alias("ms"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t"))
    _run(streams.rolling_timings(stream), "rolling", "update")
    r = spark.table("rolling").first()
    want = streams.rolling_timings_batch(rows).first()
    assert (r["scope_key"], r["n"], r["average"], r["p95"]) == (want["scope_key"], want["n"], want["average"], want["p95"])


@pytest.fixture()
def small_partitions(spark):
    """Without it, Spark would put the few rows of a test in one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_keys_are_scanned_by_ranges(spark, small_partitions):
    """One key with all rows is spread over ranges; values cross them as in a window."""
    from pyspark.sql import Window

    from pixelloom.operators import ranges

    n = 3000
    rows = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("t"), (F.col("id") < 1700).cast("string").alias("scope_key"), F.col("id").cast("double").alias("ms"))
    other = spark.createDataFrame([(None, 5, 3, None, 1.0), (None, 6, 1, None, 2.0), ("z", 1, 9, "a", 0.0)], "key string, seq long, t long, scope_key string, ms double")
    rows = rows.unionByName(other).repartition(3)
    assert ranges.ranged(rows, ["key"], "seq").where("key = 'k'").select("_part").distinct().count() > 1
    w = Window.partitionBy("key").orderBy("seq")
    place = rows.withColumn("p", F.row_number().over(w))
    want = {(r["key"], r["seq"]): r["m"] for r in place.select("key", "seq", (F.max(F.col("t") - F.col("p")).over(w) + F.col("p")).alias("m")).collect()}
    assert {(r["key"], r["seq"]): r["monotonic_ts"] for r in metrics.monotonic(rows, ["key"], "seq", "t").collect()} == want
    lag = {(r["key"], r["seq"]): r["d"] for r in rows.select("key", "seq", (F.col("t") - F.coalesce(F.lag("t").over(w), F.lit(0))).alias("d")).collect()}
    assert {(r["key"], r["seq"]): r["t"] for r in metrics.counter_delta(rows, ["key"], "seq", ["t"], ["ms"]).collect()} == lag
    kept = metrics.scoped_history(rows, ["key"], 100).collect()
    assert sorted((r["key"] or "", r["seq"]) for r in kept) == sorted([("", 5), ("", 6), ("z", 1), *(("k", i) for i in range(n - 100, n))])
    assert [r["seq"] for r in metrics.scoped_history(rows.where("key = 'k' and seq < 1703"), [], 100).orderBy("seq").collect()] == [1700, 1701, 1702]
