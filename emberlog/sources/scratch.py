"""Tables between two steps of a query, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that is unset, if all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/emberlog-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written and read again: what is random in it, such as the bounds of ranges, is decided once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
