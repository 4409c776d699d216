"""Tables between jobs: written to the shared folder and read again, which cuts their lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def place(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir.

    Without the setting a local session, which is one process, takes a temporary folder; any other
    raises ValueError, as no folder is known to be shared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return f"{folder}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """`df` as a table at a new `place`."""
    spark, path = df.sparkSession, place(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
