"""Images as packed rows, and bands of rows with a halo.

A packed row is one image row with its pixels in order.  Operators that look at neighbouring rows deal them into bands of
``BAND`` rows; a row also goes to the bands that it is a neighbour of.  So a task holds a band and its halo, however
large the image is, and no pixel is joined with another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 64


def packed(px: DataFrame, columns: Sequence[str | Column], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The keys, y and p: the pixels (x and the columns) of an image row, in order."""
    return px.select(*keys, "y", F.struct("x", *columns).alias("p")).groupBy(*keys, "y").agg(F.array_sort(F.collect_list("p")).alias("p"))


def with_halo(rows: DataFrame, radius: Column, keys: Sequence[str] = ("image_id",), only_own: Sequence[str] = ()) -> DataFrame:
    """Adds band and own (whether the band is the row's own) to rows (keys, y, ...), dealt and sorted by keys, band and y.

    The columns of ``only_own`` are null in copies for other bands.
    """
    first, last = F.greatest(F.lit(0), F.floor((F.col("y") - radius) / BAND)), F.floor((F.col("y") + radius) / BAND)
    copies = rows.withColumn("band", F.explode(F.sequence(first.cast("int"), last.cast("int")))).withColumn("own", F.col("band") == F.floor(F.col("y") / BAND))
    copies = copies.withColumns({c: F.when(F.col("own"), F.col(c)) for c in only_own})
    return copies.repartition(*keys, "band").sortWithinPartitions(*keys, "band", "y")


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for c in map(batch.column, keys):
            change |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            key = [batch.column(c)[start].as_py() for c in keys]
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    lists = column.combine_chunks()
    return pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)


def lists(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))
