"""Prefix scans over long keys: rows are ranged by key and order, so one key with all rows is spread over tasks.

Each range is scanned by itself; what a range carries over (a count, a running maximum, a last value) is a row of a small
table, whose own prefix is by key and range.  A second pass adds the carry.  Rows of equal key and order stay in one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.saved import save


def ranged(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds _key and _part, the range that holds a row; saved, so that all passes see the same ranges."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return save(rows.withColumn("_key", key).repartitionByRange("_key", order).withColumn("_part", F.spark_partition_id()), "ranges")


def _chunk(order: str):
    return Window.partitionBy("_part", "_key").orderBy(order)


def _before():
    """The ranges before one, of a key: a row each."""
    return Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_last(parts: DataFrame, order: str, values: dict[str, str]) -> DataFrame:
    """Adds columns with the value of the row before, by name, and _first for the first row of a key."""
    here = _chunk(order)
    ends = parts.groupBy("_part", "_key").agg(F.max_by(F.struct(*set(values.values())), order).alias("_end"))
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(_before())).select("_part", "_key", "_carry")
    numbered = parts.withColumn("_n", F.row_number().over(here)).withColumns({f"_lag_{name}": F.lag(c).over(here) for name, c in values.items()})
    joined = numbered.join(carried, ["_part", "_key"])
    top = F.col("_n") == 1
    found = {name: F.when(top, F.col("_carry")[c]).otherwise(F.col(f"_lag_{name}")) for name, c in values.items()}
    return joined.withColumns(found | {"_first": top & F.col("_carry").isNull()}).drop("_n", "_carry", *(f"_lag_{name}" for name in values))


def with_next(parts: DataFrame, order: str, values: dict[str, str]) -> DataFrame:
    """Adds columns with the value of the row after, by name; null for the last row of a key."""
    here = _chunk(order)
    starts = parts.groupBy("_part", "_key").agg(F.min_by(F.struct(*set(values.values())), order).alias("_start"))
    after = Window.partitionBy("_key").orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    carried = starts.withColumn("_carry", F.first("_start", ignorenulls=True).over(after)).select("_part", "_key", "_carry")
    joined = parts.withColumn("_end", F.lead(F.lit(True)).over(here).isNull()).withColumns({f"_lead_{name}": F.lead(c).over(here) for name, c in values.items()}).join(carried, ["_part", "_key"])
    found = {name: F.when(F.col("_end"), F.col("_carry")[c]).otherwise(F.col(f"_lead_{name}")) for name, c in values.items()}
    return joined.withColumns(found).drop("_end", "_carry", *(f"_lead_{name}" for name in values))


def with_running_maximum(parts: DataFrame, order: str, value: Column, out: str) -> DataFrame:
    """Adds max of (value - place) over the rows so far, plus place: places count a key's rows from 1."""
    here = _chunk(order)
    numbered = parts.withColumn("_n", F.row_number().over(here)).withColumn("_v", value - F.col("_n"))
    local = numbered.withColumn("_top", F.max("_v").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    sums = numbered.groupBy("_part", "_key").agg(F.count("*").alias("_many"), F.max("_v").alias("_most"))
    shifted = sums.withColumn("_before", F.coalesce(F.sum("_many").over(_before()), F.lit(0)))
    carried = shifted.withColumn("_carry", F.max(F.col("_most") - F.col("_before")).over(_before())).select("_part", "_key", "_before", "_carry")
    joined = local.join(carried, ["_part", "_key"])
    return joined.withColumn(out, F.greatest(F.col("_carry"), F.col("_top") - F.col("_before")) + F.col("_n") + F.col("_before")).drop("_n", "_v", "_top", "_before", "_carry")
