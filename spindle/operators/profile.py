"""Table profiles. Nulls and extremes of all columns come from one partially aggregated pass; distinct and top values from one
column-pruned pass a column, on the values as they are. Text is made of values only to show them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_sensitive, is_temporal

_TIMES = (T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def shown(value: Column, kind: T.DataType) -> Column:
    """A value as text: times by the second, fractions plainly up to 1e16 (else with an exponent), bytes as hex, nested ones as JSON."""
    if isinstance(kind, _TIMES):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0.0)  # a negative zero is the same value as zero
        text = value.cast("string")
        whole = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,17)").cast("string"), "0+$", ""), r"\.$", ".0")
        return F.when(F.abs(value).between(1e7, 9.9e15), whole).otherwise(text)
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(kind, _NESTED):
        return F.to_json(value)
    return value.cast("string")


def _groupable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def _union(parts: list[DataFrame], schema: str, like: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts) if parts else like.sparkSession.createDataFrame([], schema)


def columns(df: DataFrame, sample: int | None = None) -> DataFrame:
    """column_name, null_pct (null for a table without rows), n_distinct (of values other than null; null for maps), masked.

    ``sample``: of the first so many rows only.
    """
    df = df if sample is None else df.limit(sample)
    if not df.columns:
        return _union([], "column_name string, null_pct double, n_distinct long, masked boolean", df)
    filled = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(_at(f.name)).alias(f"c{i}") for i, f in enumerate(df.schema)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col("n"), F.col(f"c{i}").alias("filled")) for i, f in enumerate(df.schema)])
    filled = filled.select(F.inline(rows))
    each = [df.select(_at(f.name).alias("v")).where("v is not null").distinct().agg(F.lit(f.name).alias("column_name"), F.count(F.lit(1)).alias("n_distinct")) for f in df.schema if _groupable(f.dataType)]
    out = filled.join(_union(each, "column_name string, n_distinct long", df), "column_name", "left")
    return out.select("column_name", F.round(100.0 * (F.col("n") - F.col("filled")) / F.nullif(F.col("n"), F.lit(0)), 2).alias("null_pct"), "n_distinct", is_sensitive(F.col("column_name")).alias("masked"))


def _at(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _visible(df: DataFrame, keep) -> list[T.StructField]:
    """The fields that pass ``keep`` and aren't sensitive (a list of names, so settled without the table)."""
    names = [f.name for f in df.schema]
    if not names:
        return []
    flags = df.sparkSession.createDataFrame([(n,) for n in names], "n string").where(~is_sensitive(F.col("n")))
    open_ = {r[0] for r in flags.collect()}  # the names of one table's columns
    return [f for f in df.schema if f.name in open_ and keep(f.dataType)]


def top_values(df: DataFrame, k: int = 5, first: int = 20) -> DataFrame:
    """column_name, value, n: the k most frequent values of each of the ``first`` columns that aren't sensitive; ties by the text shown, null is a value."""
    parts = []
    for f in _visible(df, _groupable)[:first]:
        counts = df.groupBy(_at(f.name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        best = counts.select(F.lit(f.name).alias("column_name"), shown(F.col("v"), f.dataType).alias("value"), "n")
        parts.append(best.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k))
    return _union(parts, "column_name string, value string, n long", df)


def extremes(df: DataFrame) -> DataFrame:
    """column_name, least, greatest of the columns that have an order and aren't sensitive, by one partially aggregated pass. NaN is the greatest number."""
    kept = _visible(df, lambda t: not isinstance(t, _NESTED))
    if not kept:
        return _union([], "column_name string, least string, greatest string", df)
    wide = df.agg(*[F.min(_at(f.name)).alias(f"a{i}") for i, f in enumerate(kept)], *[F.max(_at(f.name)).alias(f"b{i}") for i, f in enumerate(kept)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column_name"), shown(F.col(f"a{i}"), f.dataType).alias("least"), shown(F.col(f"b{i}"), f.dataType).alias("greatest")) for i, f in enumerate(kept)])
    return wide.select(F.inline(rows))


def freshness(df: DataFrame) -> DataFrame:
    """The greatest value, as text, of the columns that look temporal by type or name; null if there is none."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = extremes(df)
    if not kinds:
        return rows.agg(F.max("greatest").alias("freshness"))
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return rows.where(is_temporal(F.col("column_name"), kind[F.col("column_name")])).agg(F.max("greatest").alias("freshness"))


def row_counts(tables: dict[str, DataFrame | Exception]) -> DataFrame:
    """table_name, row_count, error: one row a table; a table that couldn't be opened has the start of its error instead of a count."""
    parts, failed = [], []
    for name, table in tables.items():
        if isinstance(table, Exception):
            failed.append((name, None, str(table)[:200]))
        else:
            parts.append(table.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.lit(None).cast("string").alias("error")))
            spark = table.sparkSession
    if failed:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        parts.append(spark.createDataFrame(failed, "table_name string, row_count long, error string"))
    return reduce(DataFrame.union, parts)


def targets(nodes: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """The nodes to profile: those named by id or name, else all tables and views."""
    tables = nodes.where(F.col("type").isin("TABLE", "VIEW"))
    return tables if chosen is None else tables.where(F.col("id").isin(chosen) | F.col("name").isin(chosen))


def summaries(profile: DataFrame) -> DataFrame:
    """column_name, summary: one line a column."""
    null = F.concat(F.format_number("null_pct", 1), F.lit("% null"))
    return profile.select("column_name", F.concat_ws(", ", null, F.concat(F.col("n_distinct").cast("string"), F.lit(" distinct")), F.when(F.col("masked"), "masked")).alias("summary"))


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")
