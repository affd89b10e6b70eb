"""Lineage events as a stream: each micro-batch's edges are appended once, keyed by batch, so a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import openlineage


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """Read NDJSON files that arrive in ``folder``; write edges as Parquet under ``target``/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        openlineage.edges(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(openlineage.SCHEMA).json(folder).where(F.col("job").isNotNull())
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
