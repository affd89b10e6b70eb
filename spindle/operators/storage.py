"""Cutting the lineage of iterative work in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder of a local session. A cluster has to set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spindle-"))
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that no frame still to be run reads."""
    for table in tables:
        path = getattr(table, "_settled_path", None)
        if path:
            spark = table.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
            table._settled_path = None
