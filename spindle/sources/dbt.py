"""Graphs of dbt artifacts. Manifest, catalog, run results and source freshness are read by schema; maps of nodes are exploded, and
tests, relations and statuses are joins and aggregates over the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_META = "struct<owner:string,domain:string,terms:array<string>,deprecated:string>"
_COLUMNS = "map<string,struct<name:string,data_type:string,description:string>>"
_NODE = (
    "struct<resource_type:string,name:string,alias:string,identifier:string,source_name:string,schema:string,database:string,relation_name:string,original_file_path:string,description:string,"
    f"group:string,tags:array<string>,meta:{_META},config:struct<materialized:string,meta:{_META}>,compiled_code:string,compiled_sql:string,raw_code:string,raw_sql:string,"
    f"depends_on:struct<nodes:array<string>>,columns:{_COLUMNS}>"
)
_EXPOSURE = "struct<name:string,type:string,url:string,owner:struct<name:string,email:string>,depends_on:struct<nodes:array<string>>>"
MANIFEST = f"metadata struct<adapter_type:string>, nodes map<string,{_NODE}>, sources map<string,{_NODE}>, exposures map<string,{_EXPOSURE}>"
_CATALOGUED = "map<string,struct<columns:map<string,struct<type:string>>>>"
CATALOG = f"nodes {_CATALOGUED}, sources {_CATALOGUED}"
RESULTS = "metadata struct<generated_at:string>, results array<struct<unique_id:string,status:string,execution_time:double,max_loaded_at:string>>"

# What resources and exposures are in the graph.
KINDS = {"model": "DBT_MODEL", "seed": "DBT_SEED", "snapshot": "DBT_SNAPSHOT"}
EXPOSURES = {"dashboard": "DASHBOARD", "notebook": "REPORT", "analysis": "REPORT", "ml": "REPORT", "application": "API"}
SQL_SHOWN = 4000


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _case(value: Column, names: dict[str, str], other: str | None = None) -> Column:
    out = F.lit(other)
    for key, kind in names.items():
        out = F.when(value == key, kind).otherwise(out)
    return out


def resources(manifest: DataFrame) -> DataFrame:
    """unique_id, gid, kind, name, and what the manifest says of each model, seed, snapshot and source."""
    n = manifest.select(F.explode("nodes").alias("unique_id", "n")).where(F.col("n.resource_type").isin(*KINDS))
    n = n.withColumns({"name": F.coalesce("n.name", "unique_id"), "kind": _case(F.col("n.resource_type"), KINDS)}).withColumns({"gid": F.concat(F.lit("dbt:"), "name"), "relation": F.coalesce("n.alias", "name")})
    s = manifest.select(F.explode("sources").alias("unique_id", "n"))
    s = s.withColumns({"name": F.concat_ws(".", F.coalesce("n.source_name", F.lit("src")), F.coalesce("n.name", "unique_id")), "kind": F.lit("DBT_SOURCE")}).withColumns({"gid": F.concat(F.lit("source:"), "name"), "relation": F.coalesce("n.identifier", "n.name", "unique_id")})
    both = n.unionByName(s)
    said = lambda field: F.coalesce(F.col(f"n.meta.{field}"), F.col(f"n.config.meta.{field}"))
    tagged = F.exists(F.coalesce("n.tags", F.array().cast("array<string>")), lambda t: F.lower(t) == "deprecated")
    gone = said("deprecated")
    return both.select(
        "unique_id", "gid", "kind", "name", "relation", F.col("n.database").alias("database"), F.col("n.schema").alias("schema"), F.col("n.original_file_path").alias("path"), F.col("n.config.materialized").alias("materialized"), said("owner").alias("owner"),
        F.coalesce("n.description", F.lit("")).alias("description"), F.coalesce(said("domain"), F.col("n.group")).alias("domain"), said("terms").alias("terms"), F.when((F.coalesce(gone, F.lit("false")) != "false") | tagged, F.coalesce(F.nullif(gone, F.lit("true")), F.lit(""))).alias("deprecated"),
        F.coalesce("n.compiled_code", "n.compiled_sql", "n.raw_code", "n.raw_sql").alias("sql"), F.coalesce("n.compiled_code", "n.compiled_sql").alias("compiled"), F.col("n.depends_on.nodes").alias("needs"), F.col("n.columns").alias("columns"),
    )


def tests(manifest: DataFrame) -> DataFrame:
    """unique_id of a model, test_id, test: the tests that cover it."""
    n = manifest.select(F.explode("nodes").alias("test_id", "n")).where("n.resource_type = 'test'")
    return n.select(F.explode("n.depends_on.nodes").alias("unique_id"), "test_id", F.coalesce("n.name", "test_id").alias("test"))


def _table(database: Column, schema: Column, name: Column) -> Column:
    return F.concat(F.lit("table:"), F.lower(F.concat_ws(".", database, schema, name)))


def columns(resources_: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """gid, owner_name, name, data_type of the columns that the manifest declares or the catalog has."""
    declared = resources_.select("unique_id", F.explode("columns").alias("name", "c")).select("unique_id", F.lower("name").alias("name"), F.col("c.data_type").alias("data_type"), F.lit(0).alias("rank"))
    if catalog is not None:
        for section in ("nodes", "sources"):
            c = catalog.select(F.explode(section).alias("unique_id", "t")).select("unique_id", F.explode("t.columns").alias("name", "c"))
            declared = declared.union(c.select("unique_id", F.lower("name"), "c.type", F.lit(1)))
    merged = declared.groupBy("unique_id", "name").agg(F.min_by("data_type", F.when(F.col("data_type").isNotNull(), F.col("rank"))).alias("data_type"))
    return merged.join(resources_.select("unique_id", "gid", F.col("name").alias("owner_name")), "unique_id").select("gid", "owner_name", "name", "data_type")


def relations(resources_: DataFrame) -> DataFrame:
    """spelling, gid: the names under which SQL can mean each resource; the first resource has a name."""
    full = F.filter(F.array("database", "schema", "relation"), lambda x: x.isNotNull())
    spellings = F.transform(F.sequence(F.lit(1), F.size(full)), lambda i: F.lower(F.array_join(F.slice(full, i, F.size(full)), ".")))
    return resources_.select(F.explode(spellings).alias("spelling"), "gid", "unique_id").groupBy("spelling").agg(F.min_by("gid", F.struct(F.when(F.col("gid").startswith("dbt:"), 0).otherwise(1), "unique_id")).alias("gid"))


def resolved(names: DataFrame, relations_: DataFrame) -> DataFrame:
    """name, gid: each name of SQL by its longest dot-suffix that is a relation's spelling. Suffixes are exploded, so it is an equi-join."""
    parts = F.split(F.lower("name"), "[.]")
    tails = names.select("name", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("cut", "spelling"))
    return tails.join(relations_, "spelling").groupBy("name").agg(F.min_by("gid", "cut").alias("gid"))


def statuses(manifest: DataFrame, run_results: DataFrame | None = None, freshness: DataFrame | None = None) -> DataFrame:
    """gid, tests_passed, tests_failed, failing_tests, state, last_run, execution_time, freshness, max_loaded_at of resources that ran."""
    own = resources(manifest).select("unique_id", "gid")
    out = own.select("gid")
    if run_results is not None:
        run = run_results.select(F.col("metadata.generated_at").alias("last_run"), F.explode("results").alias("r")).select("last_run", F.col("r.unique_id").alias("ran"), F.lower("r.status").alias("status"), "r.execution_time")
        passed = F.col("status").isin("pass", "success")
        tested = tests(manifest).join(run, F.col("test_id") == F.col("ran")).join(own, "unique_id").groupBy("gid").agg(
            F.count_if(passed).alias("tests_passed"), F.count_if(~passed).alias("tests_failed"), F.sort_array(F.collect_list(F.when(~passed, F.col("test")))).alias("failing_tests"), F.max("last_run").alias("tested_at"))
        built = run.join(own, F.col("ran") == F.col("unique_id")).groupBy("gid").agg(F.max("status").alias("state"), F.max("last_run").alias("built_at"), F.round(F.max("execution_time"), 3).alias("execution_time"))
        out = out.join(tested, "gid", "left").join(built, "gid", "left").withColumn("last_run", F.coalesce("built_at", "tested_at")).drop("built_at", "tested_at")
    if freshness is not None:
        f = freshness.select(F.explode("results").alias("r")).select(F.col("r.unique_id").alias("unique_id"), F.lower("r.status").alias("freshness"), "r.max_loaded_at").join(own, "unique_id").drop("unique_id")
        out = out.join(f, "gid", "left")
    return out.where(reduce(Column.__or__, [F.col(c).isNotNull() for c in out.columns if c != "gid"], F.lit(False)))


def graph(manifest: DataFrame, catalog: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): resources, their files, relations and columns, exposures, and what depends on what."""
    own = resources(manifest)
    none = F.lit(None).cast("string")

    def nodes(df, id_, kind, name, path=none, parent=none, data_type=none, owner=none, description=none):
        return df.select(id_.alias("id"), kind.alias("type"), name.alias("name"), path.alias("path"), parent.alias("parent"), data_type.alias("data_type"), F.lit(None).cast("boolean").alias("primary_key"), owner.alias("owner"), description.alias("description"))

    def edges(df, src, dst, kind):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit("extracted").alias("provenance"), none.alias("via"))

    c = F.col
    dbt = own.where("kind <> 'DBT_SOURCE'")
    stored = dbt.where("schema is not null").withColumn("table", _table(c("database"), c("schema"), c("relation")))
    filed = dbt.where("path is not null").withColumn("file", F.concat(F.lit("file:"), "path"))
    cols = columns(own, catalog).withColumn("id", F.concat(F.lit("column:"), "owner_name", F.lit("."), "name"))
    shown = manifest.select(F.explode("exposures").alias("unique_id", "x")).withColumns({"name": F.coalesce("x.name", "unique_id")}).withColumn("gid", F.concat(F.lit("exposure:"), "name"))
    all_nodes = [
        nodes(own, c("gid"), c("kind"), c("name"), c("path"), owner=c("owner"), description=c("description")),
        nodes(filed, c("file"), F.lit("FILE"), c("path"), c("path")),
        nodes(stored, c("table"), F.when(c("materialized") == "view", "VIEW").otherwise("TABLE"), F.substring_index("table", ":", -1), owner=c("owner")),
        nodes(cols, c("id"), F.lit("COLUMN"), c("name"), parent=c("gid"), data_type=c("data_type")),
        nodes(shown, c("gid"), _case(c("x.type"), EXPOSURES, "REPORT"), c("name"), owner=F.coalesce("x.owner.name", "x.owner.email")),
    ]
    ids = own.select(c("unique_id").alias("need"), c("gid").alias("needed"))
    last = F.substring_index("need", ".", -1)
    fallback = F.when(c("need").startswith("source."), F.concat(F.lit("source:"), F.substring_index("need", ".", -2))).when(c("need").startswith("exposure."), F.concat(F.lit("exposure:"), last)).otherwise(F.concat(F.lit("dbt:"), last))
    needed = lambda df: df.join(ids, "need", "left").withColumn("needed", F.coalesce("needed", fallback))
    all_edges = [
        edges(filed, c("file"), c("gid"), "CONTAINS"), edges(stored, c("gid"), c("table"), "WRITES_TO"), edges(cols, c("gid"), c("id"), "CONTAINS"),
        edges(needed(dbt.select("gid", F.explode("needs").alias("need"))), c("gid"), c("needed"), "DEPENDS_ON"),
        edges(needed(shown.select("gid", F.explode("x.depends_on.nodes").alias("need"))), c("needed"), c("gid"), "EXPOSES"),
    ]
    return reduce(DataFrame.union, all_nodes).distinct(), reduce(DataFrame.union, all_edges).distinct()


def column_lineage(spark: SparkSession, manifest: DataFrame, catalog: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, unparsed) of columns on columns, from compiled SQL; source tables are resolved to resources, others dropped."""
    from ..plans.lineage import lineage

    own = resources(manifest)
    known: dict[str, list[str]] = {}
    spelled = relations(own).join(columns(own, catalog), "gid").groupBy("spelling").agg(F.sort_array(F.collect_set("name")).alias("names"))
    for r in spelled.collect():  # names of one project's models and columns
        known[r["spelling"]] = r["names"]
    out, failed = [], []
    for r in own.where("kind = 'DBT_MODEL' and compiled is not null").select("name", "compiled").collect():
        try:
            found = lineage(spark, r["compiled"], known)
        except Exception as error:  # reported; the other models go on
            failed.append((f"dbt model {r['name']}", r["compiled"], str(error)[:200]))
            continue
        out += [(r["name"], column, table, source) for column, leaves in found.columns.items() for table, source in leaves]
    rows = spark.createDataFrame(out, "model string, column string, name string, source string")
    hit = rows.join(resolved(rows.select("name").distinct(), relations(own)), "name")
    bare = F.regexp_replace("gid", "^[^:]*:", "")
    edges = hit.select(F.concat(F.lit("column:"), "model", F.lit("."), "column").alias("src"), F.concat(F.lit("column:"), bare, F.lit("."), "source").alias("dst"), F.lit("DEPENDS_ON").alias("type"), F.lit("extracted").alias("provenance"), F.lit("sql").alias("via"))
    return edges.distinct(), spark.createDataFrame(failed, "path string, sql string, error string")
