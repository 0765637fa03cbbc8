"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine verification, components.

Equal vectors of a label form a class, which one of them stands for.  Every class is hashed into ``TABLES`` tables of
``BITS`` hyperplane signs; classes of one label that share a bucket are compared by cosine in double precision.  With
20 bits and 32 tables, a pair at cosine 0.98 shares no bucket with probability 5e-5, and a nearer pair less often.

Buckets of one class are dropped before any vector is moved.  A bucket of more than ``BLOCK`` classes is salted into
parts, and every pair of parts is a block of its own, so a hot bucket spreads over many tasks and nothing is capped.
A block returns link counts and a spanning forest, not pairs; a pair counts only in the first table that it shares.

Null, zero or non-finite vectors, and rows with a null label, link with nothing.  Vectors of different length never
link.  Repeated rows are vectors of their own; a null vec_id links with nothing, has a null component and is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.components import components
from pixelloom.llm.storage import drop, save

THRESHOLD, BITS, TABLES, BLOCK, SEED = 0.98, 20, 32, 512, 7


def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def signatures(vectors: np.ndarray, tables: int = TABLES, bits: int = BITS) -> np.ndarray:
    """A bucket number for each row and table."""
    signs = (vectors @ _planes(vectors.shape[1], tables, bits)) >= 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def hashed(embeddings: DataFrame, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """vec_id, label, dim, f1, f2 (fingerprint), vector (bytes of doubles), buckets; the last five are null if invalid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("embedding").to_pylist()
            labels = batch.column("label").is_valid().to_pylist()
            out: list[dict | None] = [None] * len(rows)
            by_dim: dict[int, list[int]] = {}
            for i, x in enumerate(rows):
                if labels[i] and x and None not in x:
                    by_dim.setdefault(len(x), []).append(i)
            for dim, own in by_dim.items():
                v = np.array([rows[i] for i in own], np.float64)
                good = np.isfinite(v).all(1) & (v != 0).any(1)
                v, own = v[good], np.array(own)[good]
                with np.errstate(over="ignore"):
                    scaled = v / np.abs(v).max(1, keepdims=True)
                unit = scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))
                for i, raw, u, s in zip(own.tolist(), v, unit, signatures(unit, tables, bits), strict=True):
                    f = np.frombuffer(hashlib.blake2b(raw.tobytes(), digest_size=16).digest(), np.int64)
                    out[i] = {"dim": dim, "f1": int(f[0]), "f2": int(f[1]), "vector": u.tobytes(), "buckets": s}
            column = lambda name, kind: pa.array([x and x[name] for x in out], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), column("dim", pa.int32()), column("f1", pa.int64()), column("f2", pa.int64()), column("vector", pa.binary()), column("buckets", pa.list_(pa.int64()))],
                ["vec_id", "label", "dim", "f1", "f2", "vector", "buckets"],
            )

    kind, label = (embeddings.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    return embeddings.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kind}, label {label}, dim int, f1 long, f2 long, vector binary, buckets array<long>")


def _blocks(classes: DataFrame, block: int) -> DataFrame:
    """t (table), and left and right class lists (right null within a part) of every block of a shared bucket."""
    rows = classes.select("class_id", "label", "dim", F.posexplode("buckets").alias("t", "bucket"))
    shared = rows.groupBy("label", "dim", "t", "bucket").agg(F.count("*").alias("held")).where("held > 1")
    members = rows.join(shared, ["label", "dim", "t", "bucket"]).withColumn("parts", F.ceil(F.col("held") / block).cast("int"))
    salted = members.withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
    # a class of part p goes to the blocks (i, j), i <= j, that hold p
    placed = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "class_id", "label", "dim", "t", "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("is_right")
    )
    vectors = classes.select("class_id", "label", "dim", "copies", "vector", "buckets")
    full = placed.join(vectors, ["class_id", "label", "dim"])
    one = F.struct("class_id", "copies", "vector", "buckets")
    grouped = full.groupBy("label", "dim", "t", "bucket", "i", "j").agg(F.collect_list(F.when(~F.col("is_right"), one)).alias("left"), F.collect_list(F.when(F.col("is_right"), one)).alias("right"))
    return grouped.select("t", (F.col("i") == F.col("j")).alias("within"), "left", "right")


def _compare(blocks: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(a, b null, n): n vectors linked with class a, or (a, b, 0): a link, of every block."""

    def block(t: int, within: bool, left: list[dict], right: list[dict]) -> Iterator[tuple]:
        right = left if within else right
        if not left or not right:
            return
        x, y = (np.array([np.frombuffer(r["vector"]) for r in side]) for side in (left, right))
        linked = x @ y.T >= threshold
        if within:
            linked = np.triu(linked, 1)
        i, j = np.nonzero(linked)
        if not len(i):
            return
        sx, sy = (np.array([r["buckets"] for r in side]) for side in (left, right))
        mine = np.concatenate([(sx[p] == sy[q]).argmax(1) == t for p, q in zip(np.array_split(i, len(i) // 50_000 + 1), np.array_split(j, len(i) // 50_000 + 1), strict=True)])
        i, j = i[mine], j[mine]
        copies_x, copies_y = (np.array([r["copies"] for r in side]) for side in (left, right))
        for side, n in ((left, np.bincount(i, copies_y[j], len(left))), (right, np.bincount(j, copies_x[i], len(right)))):
            yield from ((side[k]["class_id"], None, int(n[k])) for k in np.flatnonzero(n))
        parent: dict = {}

        def root(v):
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            a, b = root(left[p]["class_id"]), root(right[q]["class_id"])
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield left[p]["class_id"], right[q]["class_id"], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for t, within, left, right in zip(*(batch.column(c) for c in ("t", "within", "left", "right")), strict=True) for row in block(t.as_py(), within.as_py(), left.as_py(), right.as_py())]
            arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], arrow), pa.array([r[1] for r in out], arrow), pa.array([r[2] for r in out], pa.int64())], ["a", "b", "n"])

    return blocks.mapInArrow(run, f"a {kind}, b {kind}, n long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept, of every row of embeddings."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = save(hashed(embeddings, tables, bits), "hashed")
    keys = ["label", "dim", "f1", "f2"]
    able = rows.where("vec_id is not null and f1 is not null")
    counted = able.groupBy(*keys).agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"))
    first = able.groupBy(*keys).agg(F.min(F.struct("vec_id", "vector", "buckets")).alias("x"), F.count("*").alias("copies"))
    classes = save(first.select(F.col("x.vec_id").alias("class_id"), "label", "dim", "copies", F.col("x.vector").alias("vector"), F.col("x.buckets").alias("buckets")), "classes")
    found = save(_compare(_blocks(classes, block), kind, threshold), "found")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked"))
    parts = components(found.where("b is not null").select("a", "b"))
    per_class = counted.join(links, counted["class_id"] == links["a"], "left").join(parts, counted["class_id"] == parts["node"], "left")
    per_class = per_class.select(*keys, (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    joined = rows.select("vec_id", *keys).join(per_class, keys, "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    result = joined.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
    drop(classes)
    return result
