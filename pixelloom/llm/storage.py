"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster; only where the setting is absent (tests, a local
session) is a folder under the warehouse used instead.  Tables written here survive the loss of an executor,
and they cut the lineage of iterative jobs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch: texts may be long, and a Python worker holds a batch and what it makes of it.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS and BATCH_BYTES, for operators whose rows are whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_pixelloom_tmp").rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved._pixelloom_path = path
    return saved


def drop(*tables: DataFrame) -> None:
    """Remove tables made by :func:`save` that no returned DataFrame reads."""
    for df in tables:
        if path := getattr(df, "_pixelloom_path", None):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

