"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where driver and executors are one process (tests) and the
    setting is absent, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quill-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch: rows of whole texts, pages or sets are long, and a worker holds a batch more than once.
BATCH_BYTES = 8 << 20
_UNSET = "67108864b"  # as Spark has it


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes; a setting the user has changed stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == _UNSET:
        spark.conf.set(key, str(BATCH_BYTES))


def scratch(df: DataFrame) -> DataFrame:
    """Cut lineage at a table in the folder of spark.checkpoint.dir (all executors reach it)."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
