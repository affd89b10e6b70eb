"""From a diff of a repository to the nodes that it changes."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def diff_lines(spark: SparkSession, repository: str, base: str, head: str = "HEAD") -> DataFrame:
    """line_no, line of ``git diff`` without context between two revisions."""
    for revision in (base, head):
        if revision.startswith("-"):
            raise ValueError(f"not a revision: {revision}")
    out = subprocess.run(["git", "-C", repository, "diff", "--unified=0", "--no-color", base, head, "--"], capture_output=True, check=True).stdout.decode("utf-8", "replace")
    return spark.createDataFrame(list(enumerate(out.splitlines())), "line_no long, line string")


def changed_ranges(lines: DataFrame) -> DataFrame:
    """path, first, last of each changed run of lines; a file that only loses lines, or is binary, has a row without them.

    A hunk belongs to the last file header above it: one ordered pass over the diff of one request.
    """
    path = F.regexp_extract("line", r"^(?:diff --git a/.* b/)(.*)$", 1)
    rows = lines.withColumn("path", F.last(F.nullif(path, F.lit("")), True).over(Window.orderBy("line_no")))
    start, count = F.regexp_extract("line", _HUNK, 1).try_cast("long"), F.regexp_extract("line", _HUNK, 2)
    size = F.when(count == "", 1).otherwise(count.try_cast("long"))
    hunks = rows.where(F.col("line").rlike(_HUNK)).select("path", start.alias("first"), (start + size - 1).alias("last")).where("last >= first")
    files = rows.where("path is not null").select("path").distinct().join(hunks, "path", "left_anti").select("path", F.lit(None).cast("long"), F.lit(None).cast("long"))
    return hunks.union(files)


def _tails(path) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def matched_paths(paths: DataFrame, known: DataFrame) -> DataFrame:
    """path, known: equal paths, or one a tail of the other at a slash. Tails are exploded, so both joins are equi-joins."""
    a = paths.select("path").distinct()
    b = known.select("known").distinct()
    longer = a.select("path", F.explode(_tails(F.col("path"))).alias("known")).join(b, "known").select("path", "known")
    shorter = b.select("known", F.explode(_tails(F.col("known"))).alias("path")).join(a, "path").select("path", "known")
    return longer.union(shorter).distinct()


def changed_nodes(ranges: DataFrame, nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """id of the nodes of changed files: those with a span (id, first_line, last_line) only if a changed run meets it.

    Files without runs, and nodes without a span, count as changed whole.
    """
    r = ranges.join(matched_paths(ranges, nodes.where("path is not null").select(F.col("path").alias("known"))), "path")
    own = nodes.where("path is not null").select("id", F.col("path").alias("known")).join(spans, "id", "left")
    meets = F.col("first").isNull() | F.col("first_line").isNull() | ((F.col("first_line") <= F.col("last")) & (F.coalesce("last_line", "first_line") >= F.col("first")))
    return own.join(r, "known").where(meets).select("id").distinct()
