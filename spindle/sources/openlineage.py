"""OpenLineage events (NDJSON or a JSON array) as nodes and edges, in batch or from a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELD = "struct<namespace:string,name:string,field:string>"
_SET = f"struct<namespace:string,name:string,facets:struct<schema:struct<fields:array<struct<name:string,type:string>>>,columnLineage:struct<fields:map<string,struct<inputFields:array<{_FIELD}>>>>>>"
SCHEMA = f"eventType string, eventTime string, job struct<namespace:string,name:string>, inputs array<{_SET}>, outputs array<{_SET}>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array or object a file (multi-line), or an object a line; told apart by the parse."""
    lines = spark.read.schema(f"{SCHEMA}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null and job is not null").drop("_corrupt")
    return lines if not lines.isEmpty() else spark.read.schema(SCHEMA).option("multiLine", True).json(path).where("job is not null")


def _table(d: Column) -> Column:
    return F.concat(F.lit("table:"), F.lower(d["name"]))


def _column(d: Column, name: Column) -> Column:
    return F.concat(F.lit("column:"), F.lower(d["name"]), F.lit("."), F.lower(name))


def edges(events: DataFrame) -> DataFrame:
    """src, dst, type, provenance, via: job on inputs, job to outputs, output on each other input, and columns on columns."""
    job = F.concat(F.lit("job:"), F.col("job.namespace"), F.lit("."), F.col("job.name"))
    ins = events.select(job.alias("job"), F.explode("inputs").alias("i")).select("job", _table(F.col("i")).alias("input"))
    outs = events.select(job.alias("job"), F.explode("outputs").alias("o"), "inputs")
    pairs = outs.select(_table(F.col("o")).alias("output"), F.explode("inputs").alias("i")).select("output", _table(F.col("i")).alias("input")).where("output <> input")
    fields = outs.select("o", F.explode("o.facets.columnLineage.fields").alias("name", "f")).select("o", "name", F.explode("f.inputFields").alias("x"))
    held = outs.select("o", F.explode("o.facets.schema.fields").alias("f"))
    row = lambda src, dst, kind, via: (src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit("extracted").alias("provenance"), F.lit(via).alias("via"))
    parts = [
        ins.select(*row(F.col("job"), F.col("input"), "DEPENDS_ON", "openlineage")),
        outs.select(*row(F.col("job"), _table(F.col("o")), "WRITES_TO", "openlineage")),
        pairs.select(*row(F.col("output"), F.col("input"), "DEPENDS_ON", "openlineage")),
        held.select(*row(_table(F.col("o")), _column(F.col("o"), F.col("f.name")), "CONTAINS", "openlineage")),
        fields.select(*row(_column(F.col("o"), F.col("name")), _column(F.col("x"), F.col("x.field")), "DEPENDS_ON", "openlineage")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()
