"""What to do about a change: its risk, the tests to run, the owners to tell, and what to be warned of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analysis, store, traverse

#: Names shown in the dbt line.
SHOWN = 5


@dataclass
class Impact:
    """Frames of one analysis."""

    roots: DataFrame
    affected: DataFrame
    risk: DataFrame
    tests: DataFrame
    owners: DataFrame
    warnings: DataFrame


def _test(kind: Column) -> Column:
    c, s = F.col, F.lit
    return (
        F.when(kind == "COLUMN", F.concat(s("Test column '"), c("name"), s("' of "), F.coalesce("parent", s("")), s(" for nulls and relationships")))
        .when(kind.isin("TABLE", "VIEW"), F.concat(s("Check the schema contract of "), c("name"), s(" (column names, types)")))
        .when(kind == "FUNCTION", F.concat(s("Run the unit tests of "), F.coalesce("path", "name"), s(" (function '"), c("name"), s("')")))
        .when(kind == "API", F.concat(s("Run the contract test of API '"), c("name"), s("'")))
        .when(kind == "LAMBDA", F.concat(s("Invoke lambda '"), c("name"), s("' in an integration test")))
        .when(kind.isin("DASHBOARD", "REPORT", "EXPOSURE"), F.concat(s("Look at '"), c("name"), s("' after the deployment (numbers, filters)")))
        .when(kind == "DAG", F.concat(s("Run DAG '"), c("name"), s("' outside production")))
        .when(kind == "TASK", F.concat(s("Run task '"), c("name"), s("' of DAG '"), F.coalesce("parent", s("?")), s("' outside production")))
    )


def recommended_tests(affected: DataFrame, nodes: DataFrame) -> DataFrame:
    """place, test: a test a kind of affected node, each once; dbt models share one line with the first names. One line if nothing is affected."""
    rows = nodes.join(affected.select(F.col("node").alias("id"), "depth"), "id")
    each = rows.select("depth", _test(F.col("type")).alias("test")).where("test is not null").groupBy("test").agg(F.min("depth").alias("place"))
    models = rows.where(F.col("type").isin("DBT_MODEL", "DBT_SNAPSHOT")).agg(F.sort_array(F.collect_set("name")).alias("names"))
    listed = F.array_join(F.transform(F.slice("names", 1, SHOWN), lambda n: F.concat(n, F.lit("+"))), " ")
    dbt = models.where("size(names) > 0").select(F.concat(F.lit("dbt build --select "), listed).alias("test"), F.lit(1_000_000).alias("place"))
    nothing = affected.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("Nothing is downstream; run the usual tests").alias("test"), F.lit(0).alias("place"))
    return each.union(dbt).union(nothing).select("place", "test")


def owners(affected: DataFrame, nodes: DataFrame) -> DataFrame:
    """owner, assets: who owns what is affected, names sorted."""
    rows = nodes.where("owner is not null and owner <> ''").join(affected.select(F.col("node").alias("id")).distinct(), "id")
    return rows.groupBy("owner").agg(F.sort_array(F.collect_set("name")).alias("assets"))


def warnings(affected: DataFrame, roots: DataFrame, nodes: DataFrame, deprecated: DataFrame | None = None, statuses: DataFrame | None = None) -> DataFrame:
    """id, warning: deprecated assets that are affected; failing tests and stale sources that are affected or changed.

    ``deprecated``: id, reason, replacement. ``statuses``: id, tests_failed, failing_tests, freshness, max_loaded_at.
    """
    hit = affected.select(F.col("node").alias("id")).distinct()
    named = nodes.select("id", "name")
    s = F.lit
    out = nodes.sparkSession.createDataFrame([], "id string, warning string")
    if deprecated is not None:
        use = F.when(F.col("replacement").isNotNull(), F.concat(s("; use "), "replacement")).otherwise("")
        why = F.when(F.coalesce("reason", s("")) != "", F.concat(s(" ("), "reason", s(")"))).otherwise("")
        out = out.union(deprecated.join(hit, "id", "left_semi").join(named, "id").select("id", F.concat(s("'"), "name", s("' is deprecated"), use, why)))
    if statuses is not None:
        both = statuses.join(hit.union(roots.select(F.col("root").alias("id"))).distinct(), "id", "left_semi").join(named, "id")
        which = F.when(F.size("failing_tests") > 0, F.concat(s(": "), F.array_join(F.slice("failing_tests", 1, 3), ", "))).otherwise("")
        out = out.union(both.where("tests_failed > 0").select("id", F.concat(s("'"), "name", s("' has "), F.col("tests_failed").cast("string"), s(" failing tests"), which)))
        since = F.when(F.col("max_loaded_at").isNotNull(), F.concat(s(" (last loaded "), "max_loaded_at", s(")"))).otherwise("")
        out = out.union(both.where("freshness in ('warn', 'error')").select("id", F.concat(s("freshness of '"), "name", s("': "), "freshness", since)))
    return out


def analyse(spark: SparkSession, nodes: DataFrame, edges: DataFrame, changed: list[str], max_depth: int | None = None, include_inferred: bool = True, row_counts: DataFrame | None = None, deprecated: DataFrame | None = None, statuses: DataFrame | None = None) -> Impact:
    """Resolve the references, and work out all that follows from a change of them."""
    found = store.resolve(nodes, spark.createDataFrame([(c,) for c in dict.fromkeys(changed)], "ref string"))
    roots = found.where("id is not null").select(F.col("id").alias("root")).distinct()
    affected = traverse.blast_radius(nodes, edges, roots, max_depth, include_inferred).groupBy("node").agg(F.min("depth").alias("depth"))
    return Impact(roots, affected, analysis.risk(affected, nodes, row_counts), recommended_tests(affected, nodes), owners(affected, nodes), warnings(affected, roots, nodes, deprecated, statuses))
