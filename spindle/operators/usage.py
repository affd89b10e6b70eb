"""Query-log usage on measured tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_counts(log: DataFrame, days: int, until=None) -> DataFrame:
    """object_name, queries, last_query of the ``days`` before the log's last entry (or ``until``). ``log``: object_name, ts."""
    end = log.agg(F.max("ts").alias("end")) if until is None else None
    rows = log.crossJoin(F.broadcast(end)) if end is not None else log.withColumn("end", until)  # one row
    rows = rows.where(F.col("ts") >= F.col("end") - F.expr(f"make_interval(0, 0, 0, {int(days)})"))
    return rows.groupBy(F.lower("object_name").alias("object_name")).agg(F.count(F.lit(1)).alias("queries"), F.max("ts").alias("last_query"))


def on_tables(tables: DataFrame, usage: DataFrame) -> DataFrame:
    """id, queries, last_query of every table, zero where the log has none; a longer object name matches by its dot-suffixes."""
    parts = F.split("object_name", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    names = usage.select("queries", "last_query", F.explode(suffixes).alias("name"))
    own = tables.select("id", F.lower(F.regexp_replace("id", "^[^:]*:", "")).alias("name"))
    return own.join(names, "name", "left").groupBy("id").agg(F.coalesce(F.sum("queries"), F.lit(0)).alias("queries"), F.max("last_query").alias("last_query"))


def unused(tables: DataFrame, downstream: DataFrame) -> DataFrame:
    """id, safe_to_drop of tables without queries; safe if nothing but columns is downstream. ``downstream``: id, n."""
    return tables.where("queries = 0").join(downstream, "id", "left").select("id", (F.coalesce("n", F.lit(0)) == 0).alias("safe_to_drop"))
