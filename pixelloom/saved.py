"""Tables that several steps read: written once to the folder that driver and executors share, and read back.

``spark.checkpoint.dir`` names that folder on a cluster; only where it is unset (tests, a local session) is a folder
under the warehouse used.  A saved table cuts the lineage and survives the loss of an executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def save(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_pixelloom_tmp").rstrip("/")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
