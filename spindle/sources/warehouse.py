"""Graphs of database catalogs: information-schema frames, SQLite files, and the small facts about connections that scans need."""

from __future__ import annotations

import sqlite3
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .builder import Rows
from .sql import views_graph

# Schemas of engines themselves, catalogs that are none, SQL dialects and modules of engines.
SYSTEM_CATALOGS = ("system", "temp")
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast", "mysql", "performance_schema", "sys", "snowflake", "duckdb_internal", "pg_internal", "sqlite_schema", "account_usage")
NO_CATALOG = ("def", "", "none", "null")
ENGINES = {"snowflake": "snowflake", "psycopg": "postgres", "pg8000": "postgres", "asyncpg": "postgres", "pymysql": "mysql", "mysql": "mysql", "bigquery": "bigquery", "duckdb": "duckdb", "sqlite": "sqlite", "pyodbc": "sqlserver", "pymssql": "sqlserver", "redshift": "redshift"}
DIALECTS = {"sqlserver": "tsql"}


def engine(connection) -> str | None:
    """The engine of an open connection, by its driver's module; wrappers are looked through."""
    module = type(unwrapped(connection)).__module__.lower()
    return next((name for part, name in ENGINES.items() if part in module), None)


def unwrapped(connection, hops: int = 5):
    """The driver's own connection inside at most ``hops`` wrappers."""
    for _ in range(hops):
        inner = next((x for a in ("driver_connection", "dbapi_connection", "connection") if (x := getattr(connection, a, None)) is not None and not callable(x)), None)
        if inner is None or inner is connection:
            break
        connection = inner
    return connection


def dialect(engine_name: str | None) -> str | None:
    return DIALECTS.get(engine_name, engine_name) if engine_name else None


def connection_options(dsn: str) -> dict[str, str]:
    """How Spark reads what a connection string names: a SQLite file, Parquet tables of a folder, or JDBC."""
    parts = urlsplit(dsn)
    if parts.scheme == "sqlite" or ("://" not in dsn and dsn.lower().endswith((".db", ".sqlite", ".sqlite3"))):
        return {"format": "sqlite", "path": dsn.split(":///", 1)[-1]}
    if "://" not in dsn:
        return {"format": "parquet", "path": dsn}
    host = f"{parts.hostname or ''}:{parts.port}" if parts.port else parts.hostname or ""
    out = {"format": "jdbc", "url": f"jdbc:{parts.scheme.split('+')[0]}://{host}{parts.path}"}
    return out | ({"user": parts.username} if parts.username else {}) | ({"password": parts.password} if parts.password else {})


def table_id(catalog: Column, schema: Column, name: Column) -> Column:
    """The id of a table; catalogs that only fill a place are left out."""
    catalog = F.when(F.lower(F.trim(catalog)).isin(*NO_CATALOG), None).otherwise(catalog)
    return F.concat(F.lit("table:"), F.lower(F.concat_ws(".", F.nullif(catalog, F.lit("")), F.nullif(schema, F.lit("")), name)))


def user_objects(rows: DataFrame, database: str | None = None, schemas: list[str] | None = None) -> DataFrame:
    """Rows of (table_catalog, table_schema, ...) that aren't the engine's own; an explicit database or schema list decides alone."""
    if database:
        rows = rows.where(F.lower("table_catalog") == database.lower())
    if schemas:
        return rows.where(F.lower("table_schema").isin([s.lower() for s in schemas]))
    own = F.coalesce(F.lower("table_schema").isin(*SYSTEM_SCHEMAS), F.lit(False))
    return rows.where(~own & (F.lit(bool(database)) | ~F.coalesce(F.lower("table_catalog").isin(*SYSTEM_CATALOGS), F.lit(False))))


def foreign_keys(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """child_table, child_column, parent_table, parent_column, constraint_name: constraints joined to both sides' key columns by place."""
    of = lambda side: table_id(F.col(f"{side}.table_catalog"), F.col(f"{side}.table_schema"), F.col(f"{side}.table_name"))
    child = (F.col("c.constraint_name") == F.col("r.constraint_name")) & (F.col("c.constraint_schema") == F.col("r.constraint_schema"))
    parent = (F.col("p.constraint_name") == F.col("r.unique_constraint_name")) & (F.col("p.constraint_schema") == F.col("r.unique_constraint_schema")) & (F.col("p.ordinal_position") == F.col("c.ordinal_position"))
    rows = constraints.alias("r").join(usage.alias("c"), child).join(usage.alias("p"), parent)
    return rows.select(of("c").alias("child_table"), F.lower("c.column_name").alias("child_column"), of("p").alias("parent_table"), F.lower("p.column_name").alias("parent_column"), F.col("r.constraint_name").alias("constraint_name"))


def graph(tables: DataFrame, columns: DataFrame, keys: DataFrame | None = None, views: DataFrame | None = None, database: str | None = None, schemas: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of information-schema rows: tables, columns in order, ``keys`` as of foreign_keys(), definitions of ``views``."""
    spark, none = tables.sparkSession, F.lit(None).cast("string")
    tables, columns = (user_objects(x, database, schemas) for x in (tables, columns))
    id_ = table_id(F.col("table_catalog"), F.col("table_schema"), F.col("table_name"))
    bare = lambda x: F.regexp_replace(x, "^[^:]*:", "")
    n = tables.select(id_.alias("id"), F.when(F.upper("table_type") == "VIEW", "VIEW").otherwise("TABLE").alias("type"), bare(id_).alias("name"), none.alias("path"), none.alias("parent"), none.alias("data_type"))
    cols = columns.select(id_.alias("parent"), F.lower("column_name").alias("name"), F.col("data_type"), "ordinal_position").withColumn("id", F.concat(F.lit("column:"), bare(F.col("parent")), F.lit("."), "name"))
    n = n.union(cols.select("id", F.lit("COLUMN"), "name", none, "parent", "data_type"))
    row = lambda df, s, d, kind, via: df.select(s.alias("src"), d.alias("dst"), F.lit(kind).alias("type"), F.lit("extracted").alias("provenance"), via.alias("via"))
    e = row(cols, F.col("parent"), F.col("id"), "CONTAINS", none)
    if keys is not None:
        column = lambda side: F.concat(F.lit("column:"), bare(F.col(f"{side}_table")), F.lit("."), F.col(f"{side}_column"))
        fk = F.lit("foreign_key")
        e = e.union(row(keys, column("child"), column("parent"), "DEPENDS_ON", fk)).union(row(keys.where("child_table <> parent_table").select("child_table", "parent_table").distinct(), F.col("child_table"), F.col("parent_table"), "DEPENDS_ON", fk))
    if views is not None:
        shape: dict[str, list[str]] = {}
        for r in cols.select(bare(F.col("parent")).alias("t"), "name", "ordinal_position").orderBy("t", "ordinal_position").collect():  # a catalog's columns
            shape.setdefault(r["t"], []).append(r["name"])
        shape |= {t.split(".", 1)[1]: c for t, c in shape.items() if t.count(".") == 2}
        found = views_graph(spark, [tuple(r) for r in user_objects(views, database, schemas).select(id_, "view_definition").collect()], shape)[1]
        e = e.union(found.select("src", "dst", "type", "provenance", "via")).distinct()
    return n.distinct(), e


def sqlite_graph(spark: SparkSession, path: str, view_lineage: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a SQLite file's tables, views, columns and foreign keys. A key without a target column means the other table's
    first primary key, else ``id``."""
    rows, views, shape = Rows(), [], {}
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        objects = db.execute("SELECT type, name, sql FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%'").fetchall()
        info = {name: db.execute(f"PRAGMA table_info({quoted(name)})").fetchall() for _, name, _ in objects}
        primary = {name.lower(): [c[1] for c in cols if c[5]] for name, cols in info.items()}
        for kind, name, sql in objects:
            table = rows.node(f"table:{name.lower()}", kind.upper(), name.lower())
            shape[name.lower()] = [c[1].lower() for c in info[name]]
            for c in info[name]:
                rows.column(table, c[1], c[2], bool(c[5]) or None)
            if kind == "view" and sql:
                views.append((table, sql))
        for kind, name, _ in objects:
            for key in db.execute(f"PRAGMA foreign_key_list({quoted(name)})") if kind == "table" else ():
                target = key[4] or next(iter(primary.get(key[2].lower(), [])), "id")
                child, parent = f"table:{name.lower()}", f"table:{key[2].lower()}"
                rows.edge(f"column:{name.lower()}.{key[3].lower()}", f"column:{key[2].lower()}.{target.lower()}", "DEPENDS_ON", "foreign_key")
                if child != parent:
                    rows.edge(child, parent, "DEPENDS_ON", "foreign_key")
    nodes, edges = rows.frames(spark)
    if view_lineage and views:
        more = views_graph(spark, views, shape)
        nodes, edges = nodes.union(more[0].withColumn("seq", F.col("seq") + len(rows.nodes))), edges.union(more[1].withColumn("seq", F.col("seq") + len(rows.edges)))
    return nodes, edges


def query_log_sql(engine_name: str, days: int, region: str = "region-us") -> str:
    """The statement that counts queries an object (object_name, queries, last_query) where the engine keeps a log of them."""
    days = int(days)
    return {
        "snowflake": "SELECT LOWER(o.value:\"objectName\"::string) AS object_name, COUNT(*) AS queries, MAX(query_start_time) AS last_query FROM snowflake.account_usage.access_history, "
        f"LATERAL FLATTEN(base_objects_accessed) o WHERE query_start_time >= DATEADD(day, -{days}, CURRENT_TIMESTAMP()) GROUP BY 1",
        "bigquery": "SELECT LOWER(CONCAT(t.project_id, '.', t.dataset_id, '.', t.table_id)) AS object_name, COUNT(*) AS queries, MAX(creation_time) AS last_query FROM "
        f"`{region}`.INFORMATION_SCHEMA.JOBS, UNNEST(referenced_tables) AS t WHERE creation_time >= TIMESTAMP_SUB(CURRENT_TIMESTAMP(), INTERVAL {days} DAY) GROUP BY 1",
        "postgres": "SELECT LOWER(schemaname || '.' || relname) AS object_name, COALESCE(seq_scan, 0) + COALESCE(idx_scan, 0) AS queries, NULL AS last_query FROM pg_stat_user_tables",
        "mysql": "SELECT LOWER(CONCAT(object_schema, '.', object_name)) AS object_name, SUM(count_read) AS queries, NULL AS last_query FROM performance_schema.table_io_waits_summary_by_table GROUP BY 1",
    }[engine_name]
