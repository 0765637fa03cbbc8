"""Jobs: settings, their validation and identity, and the whole image pipeline over a job table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pixelloom import schemas
from pixelloom.functions.pixel import composited, is_transparent
from pixelloom.operators import diffusion, dither, match, metrics, resize
from pixelloom.operators.dither import Settings
from pixelloom.sources.palettes import Swatch

CROP_COLUMNS = ("crop_x", "crop_y", "crop_width", "crop_height")
JOB_COLUMNS = ("width", "height", "resize", *CROP_COLUMNS, "alpha_mode", "alpha_threshold", "matte_key", "dither", "strength", "placement", "radius", "threshold", "softness", "serpentine", "seed", "use_color_space", "color_space")
#: What tells a source file from another at the same place.
SOURCE_COLUMNS = ("name", "mime", "width", "height", "updated_at")
DIFFUSION = tuple(diffusion.KERNELS)
#: Aspect shares, resize modes, dithers and colour spaces of the full study.
SCALES = (0.25, 0.5, 0.75, 1.0)
#: Identities: groups of a palette by the text before the colours, by the rest, and colours in a piece of the palette.
_HEADS, _TAILS, _PIECE = 8, 4, 128
#: Types whose values go as columns to the text of an identity, and what JSON writes for characters of a string.
_PLAIN = ("tinyint", "smallint", "int", "bigint", "boolean", "string")
_ESCAPED = {n: f"\\u{n:04X}" for n in range(32)} | {ord(c): f"\\{e}" for c, e in zip('\b\t\n\f\r"\\', 'btnfr"\\', strict=True)}


def violated() -> Column:
    """Names of a job's settings that are out of their range or enumeration."""

    def side(c: str) -> Column:
        return F.coalesce(~F.col(c).between(1, schemas.MAX_OUTPUT_SIDE), F.lit(True))

    def enum(c: str, values) -> Column:
        return F.coalesce(~F.col(c).isin(*values), F.lit(True))

    def number(c: str, low: float = float("-inf"), high: float = float("inf")) -> Column:
        """Finite, and within the limits."""
        v = F.col(c).cast("double")
        return F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")) | (v < low) | (v > high), F.lit(True))

    def crop_side(c: str) -> Column:
        v = F.col(c).cast("double")
        return number(c, 1, schemas.MAX_SOURCE_SIDE) | (v != F.floor(v))

    cropped = F.coalesce(*CROP_COLUMNS).isNotNull()
    bad_crop = number("crop_x") | number("crop_y") | crop_side("crop_width") | crop_side("crop_height")

    checks = {
        "width": side("width"),
        "height": side("height"),
        "pixels": F.coalesce(F.col("width").cast("long") * F.col("height") > schemas.MAX_PIXELS, F.lit(False)),
        "resize": enum("resize", schemas.RESIZES),
        "alpha_mode": enum("alpha_mode", schemas.ALPHA_MODES),
        "alpha_threshold": number("alpha_threshold", 0, 255),
        "dither": enum("dither", schemas.DITHERS),
        "strength": number("strength", 0),
        "placement": enum("placement", ("everywhere", "adaptive")),
        "radius": number("radius", 0),
        "threshold": number("threshold", 0),
        "softness": number("softness", 0),
        "color_space": enum("color_space", schemas.COLOR_SPACES),
        "seed": number("seed"),
        "matte_key": F.col("matte_key").isNull(),
        "crop": cropped & bad_crop,
    }
    return F.array_compact(F.array(*(F.when(bad, name) for name, bad in checks.items())))


def violations(jobs: DataFrame) -> DataFrame:
    """job_id, reasons of jobs with a setting that is out of its range or enumeration."""
    return jobs.select("job_id", violated().alias("reasons")).where(F.size("reasons") > 0)


def _bare(json: Column) -> Column:
    """The text of a JSON list or object without its brackets."""
    return F.substring(json, F.lit(2), F.length(json) - 2)


def with_identity(jobs: DataFrame, palettes: DataFrame, columns=JOB_COLUMNS, sources: DataFrame | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds settings_hash, equal for equal settings of an image and equal colours of the palette.

    keep: the columns of jobs that are returned beside it, if not all of them.

    sources (image_id and SOURCE_COLUMNS): a file's name, type, size and time of change enter too, so an image that is
    replaced at its place makes other identities, and its outputs are stale.  A job without a source has nulls there.

    palettes (palette_name, ord, key, kind, r, g, b): the colours enter in order by key, kind and rgb, so an edited
    palette makes other identities.  A job whose palette is missing has null colours.  Numbers must be finite.

    The hash is that of one JSON text, keys sorted, but no job carries the colours: jobs are grouped by palette and by
    what stands before the colours, the colours come to each group once, in pieces, and jobs go on from its state.
    The text is put together from columns in Arrow; Spark's JSON writer took most of the time, by row.
    """
    kinds = dict(jobs.dtypes)

    def value(c: str) -> Column:
        """A plain field as it is, another one as a member of JSON."""
        v = F.col(f"_job.{c}")
        if kinds[c] in _PLAIN:
            return v
        finite = ~F.isnan(v) & (F.abs(v) < float("inf")) | v.isNull() if kinds[c] in ("double", "float") else None
        return member(c, v if finite is None else F.when(finite, v).otherwise(F.raise_error(F.lit(f"{c} is not finite"))))

    def member(c: str, v: Column) -> Column:
        return _bare(F.to_json(F.struct(v.alias(c)), {"ignoreNullFields": "false"}))

    parts = {c: value(c) for c in ("image_id", "palette_name", *columns)}
    held = ["palette_name", *(c for c in jobs.columns if c != "palette_name")]
    kept = held if keep is None else list(keep)
    joined, carried = jobs, held
    if sources is not None:
        source = F.struct(*(F.unix_micros(c).alias(c) if kind == "timestamp" else F.col(c) for c, kind in sources.select(*SOURCE_COLUMNS).dtypes))
        joined, carried = jobs.join(sources.select("image_id", source.alias("_source")), "image_id", "left"), [*held, "_source"]
        parts["source"] = member("source", F.col("_job._source"))
    before, after = ([c for c in sorted(parts) if (c < "colors") == first] for first in (True, False))
    head = F.struct(*(parts[c].alias(c) for c in before))

    spread = F.pmod(F.xxhash64(*(F.col(c) for c in before)), F.lit(_HEADS)) * _TAILS + F.pmod(F.xxhash64(*(F.col(c) for c in held)), F.lit(_TAILS))
    rows = joined.select("palette_name", spread.alias("_group"), F.struct(*carried).alias("_job"))
    heads = rows.select("palette_name", "_group", head.alias("_head")).distinct()
    rgb = F.when(F.col("r").isNotNull(), F.struct("r", "g", "b"))
    color = F.struct("ord", F.struct("key", "kind", rgb.alias("rgb")).alias("color"))
    pieces = palettes.groupBy("palette_name", F.floor(F.col("ord") / _PIECE).alias("_at")).agg(F.transform(F.array_sort(F.collect_list(color)), lambda c: c["color"]).alias("c"))
    pieces = pieces.select("palette_name", "_at", _bare(F.to_json("c", {"ignoreNullFields": "false"})).cast("binary").alias("_text"))
    pieces = pieces.join(heads.select("palette_name", "_group").distinct(), "palette_name")
    order = ["palette_name", "_group", "_kind", "_at"]
    every = rows.withColumn("_kind", F.lit(2)).unionByName(heads.withColumn("_kind", F.lit(0)), True).unionByName(pieces.withColumn("_kind", F.lit(1)), True)
    dealt = every.repartition("palette_name", "_group").sortWithinPartitions(*order)
    job = F.col("_kind") == 2
    # Flat columns: Arrow's writer works out its size for every row, and structs within it took most of the time.
    texts = [F.when(job, parts[c]).otherwise(F.col(f"_head.{c}")) for c in before] + [parts[c] for c in after]
    flat = [*texts, *(F.col(f"_job.{c}") for c in kept)]
    fields = dealt.select("palette_name", "_group", "_kind", "_text", *(c.alias(f"_{n}") for n, c in enumerate(flat)))
    first, last, own = 4, 4 + len(before), 4 + len(texts)

    written, escaped = {c: kinds[c] for c in parts if kinds.get(c) in _PLAIN and (c != "source" or sources is None)}, _ESCAPED

    def lines(columns: list[pa.Array], names: list[str]) -> list[bytes]:
        """Members of JSON, by row."""
        texts = []
        for n, (c, v) in enumerate(zip(names, columns, strict=True)):
            texts.append(("," if n else "") + (f'"{c}":' if c in written else ""))
            if written.get(c) == "string":
                v = v.cast(pa.binary()).dictionary_encode()
                known = [f'"{word.decode("utf-8", "replace").translate(escaped)}"' for word in v.dictionary.to_pylist()]
                v = pa.array(known, pa.string()).take(v.indices)
            texts.append(v.cast(pa.string()).fill_null("null"))
        return pc.binary_join_element_wise(*texts, "").cast(pa.binary()).to_pylist()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, states, colors, closed = None, {}, 0, False
        for batch in batches:
            found = []
            name = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            change = np.diff(name) != 0
            for c in (1, 2):
                change |= np.diff(batch.column(c).to_numpy()) != 0
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:], strict=False) if batch.num_rows else ():
                key, kind = tuple(batch.column(c)[start].as_py() for c in (0, 1)), batch.column(2)[start].as_py()
                part = batch.slice(start, end - start).columns
                if key != group:
                    group, states, colors, closed = key, {}, 0, False
                if kind == 0:
                    states |= {text: hashlib.sha256(b"{" + text + (b"," if before else b"") + b'"colors":') for text in lines(part[first:last], before)}
                elif kind == 1:
                    for text in part[3].to_pylist():
                        for state in states.values():
                            state.update((b"," if colors else b"[") + text)
                        colors += 1
                else:
                    if not closed:
                        closed = True
                        for state in states.values():
                            state.update(b"]" if colors else b"null")
                    for text, rest in zip(lines(part[first:last], before), lines(part[last:own], after), strict=True):
                        state = states[text].copy()
                        state.update(b"," + rest + b"}")
                        found.append(state.hexdigest())
            if found:
                jobs_ = batch.filter(pc.equal(batch.column(2), 2)).columns[own:]
                yield pa.RecordBatch.from_arrays([*jobs_, pa.array(found, pa.string())], [*kept, "settings_hash"])

    return fields.mapInArrow(hashed, StructType([StructField(f.name, f.dataType) for f in jobs.select(*kept).schema] + [StructField("settings_hash", StringType(), False)]))


def branch_key(jobs: DataFrame) -> Column:
    """Key of a resized image: jobs with the same image, size, mode and crop share one resize."""
    size = F.concat_ws("x", "width", "height")
    crop = F.when(F.coalesce(*CROP_COLUMNS).isNull(), "0,0,full,full").otherwise(F.concat_ws(",", *CROP_COLUMNS))
    return F.concat_ws("|", F.col("image_id").cast("string"), size, "resize", crop)


def with_palette_counts(jobs: DataFrame, palettes: DataFrame) -> DataFrame:
    """Adds n, clear and visible to jobs: all, transparent and visible colours of their palettes; null for unknown ones.

    The counts, a row for each palette, are broadcast: where all jobs name one palette there is no key to join by, and
    Spark would broadcast the jobs.
    """
    held = palettes.groupBy("palette_name").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("ord") < schemas.MAX_COLORS) & (F.col("kind") == "transparent")).alias("clear"),
        F.count_if((F.col("ord") < schemas.MAX_COLORS) & (F.col("kind") != "transparent")).alias("visible"),
    )
    return jobs.join(F.broadcast(held), "palette_name", "left")


def warned() -> Column:
    """Warnings of a job with the counts of its palette."""
    n, clear, visible = (F.coalesce(c, F.lit(0)) for c in ("n", "clear", "visible"))
    found = F.array_compact(
        F.array(
            F.when(n > schemas.MAX_COLORS, "palette truncated to 256 colors"),
            F.when((visible == 0) & (clear > 0), "only Transparent: every pixel is transparent"),
            F.when((visible > 0) & (clear == 0) & (F.col("alpha_mode") == "preserve"), "no Transparent: masked pixels take the darkest color"),
        )
    )
    return F.when((visible == 0) & (clear == 0), F.array(F.lit("error: no color"))).otherwise(found)


def warnings(jobs: DataFrame, palettes: DataFrame) -> DataFrame:
    """job_id and warnings: what a job's palette cannot give it.

    palettes (palette_name, ord, key, kind); a job without a usable colour has the error as its only entry.
    """
    return with_palette_counts(jobs.select("job_id", "palette_name", "alpha_mode"), palettes).select("job_id", warned().alias("warnings"))


def vector_dither_applies(dither_id: Column, use_color_space: Column, color_space: Column) -> Column:
    return use_color_space & (dither_id != "none") & (color_space != "weighted-rgb")


def pending(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Jobs without an output of the same identity."""
    return jobs.join(outputs.select("settings_hash").distinct(), "settings_hash", "left_anti")


def stale(outputs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Outputs whose identity is no longer that of any job."""
    return outputs.join(jobs.select("settings_hash").distinct(), "settings_hash", "left_anti")


def exportable(outputs: DataFrame, jobs: DataFrame) -> DataFrame:
    return outputs.join(jobs.select("settings_hash").distinct(), "settings_hash", "left_semi")


def validate_indexed(indexed: DataFrame, outputs: DataFrame, palettes: DataFrame) -> DataFrame:
    """image_id, reason of outputs whose indices do not fit their size and palette.

    outputs: (image_id, palette_name, width, height, transparent_index); palettes by name and ord.
    """
    colors = palettes.groupBy("palette_name").agg(F.count("*").alias("colors"))
    held = indexed.groupBy("image_id").agg(F.count("*").alias("n"), F.max("idx").alias("top"), F.min("idx").alias("low"))
    joined = outputs.join(held, "image_id", "left").join(colors, "palette_name", "left")
    reason = (
        F.when(F.col("colors").isNull(), "no palette")
        .when(~F.col("width").between(1, schemas.MAX_OUTPUT_SIDE) | ~F.col("height").between(1, schemas.MAX_OUTPUT_SIDE), "bad size")
        .when(F.coalesce("n", F.lit(0)) != F.col("width").cast("long") * F.col("height"), "wrong pixel count")
        .when((F.col("top") >= F.col("colors")) | (F.col("low") < 0), "index outside palette")
        .when(~F.col("transparent_index").between(-1, F.col("colors") - 1), "bad transparent index")
    )
    return joined.select("image_id", reason.alias("reason")).where("reason is not null")


def case_matrix(spark: SparkSession, scales=SCALES, resizes=schemas.RESIZES, dithers=schemas.DITHERS, spaces=schemas.COLOR_SPACES, images: DataFrame | None = None) -> DataFrame:
    """Every combination of a few short lists: case_id, scale, resize, dither, color_space; with images, for each of their rows.

    The lists are settings, not data.
    """
    one = spark.range(1) if images is None else images
    held = [] if images is None else images.columns
    for name, values in (("scale", scales), ("resize", resizes), ("dither", dithers), ("color_space", spaces)):
        one = one.withColumn(name, F.explode(F.array(*map(F.lit, values))))
        if images is not None and name == "resize":  # few images are one partition
            one = one.repartition(*one.columns)
    return one.select(*held, F.concat_ws("/", "scale", "resize", "dither", "color_space").alias("case_id"), "scale", "resize", "dither", "color_space")


def quantize(px: DataFrame, palette: list[Swatch], settings: Settings) -> DataFrame:
    """Any dither by its name."""
    return (diffusion if settings.dither in DIFFUSION else dither).quantize(px, palette, settings)


def process(px: DataFrame, palette: list[Swatch], cases: list[tuple]) -> DataFrame:
    """case_id, image_id, y, x, idx of every (case_id, width, height, resize mode, settings[, crop]) over all images.

    Cases of one size, mode and crop share one resize.  A plan of its own for each case: for a handful of them; many
    are rows of a table for :func:`pixelloom.operators.job_table.process`.
    """
    resized: dict[tuple, DataFrame] = {}
    out = None
    for case_id, width, height, mode, settings, *crop in cases:
        key = (width, height, mode, *crop)
        if key not in resized:
            resized[key] = resize.resize(px, width, height, mode, *crop)
        done = quantize(resized[key], palette, settings).select(F.lit(case_id).alias("case_id"), "image_id", "y", "x", "idx")
        out = done if out is None else out.unionByName(done)
    return out


def compare_spaces(px: DataFrame, palette: list[Swatch], settings: Settings, spaces: list[str]) -> DataFrame:
    """baseline, variant, pixels, same: how often two colour spaces choose alike.

    Direct settings choose in one projection of the pixels; others are compared by the digests of their rows.
    """
    pairs = [(a, b) for a in range(len(spaces)) for b in range(a + 1, len(spaces))]
    direct = (settings.dither == "none" or settings.strength <= 0) and any(s.visible for s in palette)
    if not direct:
        done = [quantize(px, palette, replace(settings, color_space=space)) for space in spaces]
        out = None
        for a, b in pairs:
            total = metrics.agreement(done[a], done[b]).agg(F.coalesce(F.sum("pixels"), F.lit(0)).alias("pixels"), F.coalesce(F.sum("same"), F.lit(0)).alias("same"))
            row = total.select(F.lit(spaces[a]).alias("baseline"), F.lit(spaces[b]).alias("variant"), "pixels", "same")
            out = row if out is None else out.unionByName(row)
        return out
    masked = is_transparent(F.col("a"), settings.alpha_mode, settings.alpha_threshold)
    seen = composited(tuple(F.col(c) for c in "rgb"), F.col("a"), settings.alpha_mode, settings.matte)
    chosen = px.withColumns({f"_{c}": v for c, v in zip("rgb", seen, strict=True)})
    for k, space in enumerate(spaces):
        chosen = match.nearest(chosen, palette, space, ("_r", "_g", "_b"), f"i{k}")
    one = chosen.agg(F.count("*").alias("pixels"), *(F.count_if(masked | (F.col(f"i{a}") == F.col(f"i{b}"))).alias(f"s{a}_{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(spaces[a]).alias("baseline"), F.lit(spaces[b]).alias("variant"), F.col(f"s{a}_{b}").alias("same")) for a, b in pairs))
    return one.select("pixels", F.explode(rows).alias("p")).select("p.baseline", "p.variant", "pixels", "p.same")
