"""The library's queries on the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions import text
from .operators import analysis, governance, impact, model, profile, store, traverse, usage
from .sources import code, dbt, openlineage, sql, warehouse
from .sources.catalog import KEYS, TABLES, catalog_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_names = ", ".join(f"'{t}'" for t in TABLES)
_CATALOG = f"""
fk(c, cc, p, pc) AS (VALUES {", ".join(str(k) for k in KEYS)}),
cols AS (SELECT DISTINCT table_name AS t, lower(column_name) AS c FROM information_schema.columns WHERE table_name IN ({_names})),
nodes AS (SELECT DISTINCT 'table:' || t AS id, 'TABLE' AS type, t AS name, CAST(NULL AS VARCHAR) AS parent FROM cols
  UNION ALL SELECT 'column:' || t || '.' || c, 'COLUMN', c, 'table:' || t FROM cols),
edges AS (SELECT 'table:' || t AS src, 'column:' || t || '.' || c AS dst, 'CONTAINS' AS type FROM cols
  UNION ALL SELECT DISTINCT 'table:' || c, 'table:' || p, 'DEPENDS_ON' FROM fk
  UNION ALL SELECT 'column:' || c || '.' || cc, 'column:' || p || '.' || pc, 'DEPENDS_ON' FROM fk),
links AS (SELECT CASE WHEN type = 'CONTAINS' THEN src ELSE dst END AS f, CASE WHEN type = 'CONTAINS' THEN dst ELSE src END AS t, type FROM edges),
walk AS (SELECT id AS root, id AS node, 0 AS depth FROM nodes
  UNION SELECT w.root, l.t, w.depth + 1 FROM walk w JOIN links l ON l.f = w.node WHERE w.depth < 12),
reach AS (SELECT root, node, min(depth) AS depth FROM walk WHERE node <> root GROUP BY ALL)"""
_WITH = f"WITH RECURSIVE {_CATALOG} "


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _roots(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "root string")


# --- profiling ---------------------------------------------------------------------------------------------------------------
_PROFILED = ("customer", "orders", "lineitem", "part", "supplier", "nation")
_SHOWN = {
    "customer": {"c_custkey": "i", "c_name": "i", "c_nationkey": "i", "c_acctbal": "d", "c_mktsegment": "i"},
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "i", "o_totalprice": "d", "o_orderdate": "t", "o_orderpriority": "i"},
    "lineitem": {"l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_quantity": "d", "l_extendedprice": "d", "l_discount": "d", "l_tax": "d", "l_returnflag": "i", "l_linestatus": "i", "l_shipdate": "t"},
    "part": {"p_partkey": "i", "p_name": "i", "p_brand": "i", "p_type": "i", "p_size": "i", "p_retailprice": "d"},
    "supplier": {"s_suppkey": "i", "s_name": "i", "s_nationkey": "i", "s_acctbal": "d"},
    "nation": {"n_nationkey": "i", "n_name": "i", "n_regionkey": "i"},
}
_CAST = {"i": "CAST({c} AS VARCHAR)", "d": "CAST({c} + 0.0 AS VARCHAR)", "t": "strftime({c}, '%Y-%m-%d %H:%M:%S')"}


def _sensitive_sql(n: str) -> str:
    return f"(NOT (regexp_matches({n}, '{text.KEY_PATTERN}') AND NOT regexp_matches({n}, '{text.DEVICE_PATTERN}')) AND NOT regexp_matches({n}, '{text.SAFE_PATTERN}') AND regexp_matches({n}, '{text.SENSITIVE_PATTERN}'))"


def _top_sql(table: str, column: str, kind: str) -> str:
    return f"(SELECT '{column}' AS column_name, {_CAST[kind].format(c=column)} AS value, n FROM (SELECT {column}, count(*) AS n FROM {table} GROUP BY {column}) ORDER BY n DESC, value NULLS FIRST LIMIT 5)"


def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.row_counts({t: _read(spark, sf_dir, t) for t in TABLES}).select("table_name", "row_count")


_add("profile_row_counts", _row_counts, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
for _t in _PROFILED:
    _add(
        f"profile_columns_{_t}",
        lambda s, d, t=_t: profile.columns(_read(s, d, t)),
        " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS n_distinct, {_sensitive_sql(repr(c))} AS masked FROM {_t}" for c in _SHOWN[_t]),
    )
    _add(
        f"profile_top_values_{_t}",
        lambda s, d, t=_t: profile.top_values(_read(s, d, t)),
        "SELECT * FROM (" + " UNION ALL ".join(_top_sql(_t, c, k) for c, k in _SHOWN[_t].items()) + f") WHERE NOT {_sensitive_sql('column_name')}",
    )
    _add(
        f"profile_extremes_{_t}",
        lambda s, d, t=_t: profile.extremes(_read(s, d, t)),
        "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_CAST[k].format(c=f'min({c})')} AS least, {_CAST[k].format(c=f'max({c})')} AS greatest FROM {_t}" for c, k in _SHOWN[_t].items()) + f") WHERE NOT {_sensitive_sql('column_name')}",
    )
for _t, _c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
    _add(f"profile_freshness_{_t}", lambda s, d, t=_t: profile.freshness(_read(s, d, t)), f"SELECT strftime(max({_c}), '%Y-%m-%d %H:%M:%S') AS freshness FROM {_t}")


# --- graph -------------------------------------------------------------------------------------------------------------------
def _on_graph(f: Callable[[SparkSession, DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spark, *catalog_graph(spark, sf_dir))


def _without_root(df: DataFrame) -> DataFrame:
    return df.groupBy("node").agg(F.min("depth").cast("long").alias("depth"))


_add("graph_impact", _on_graph(lambda s, n, e: _without_root(traverse.blast_radius(n, e, _roots(s, "table:customer")))), _WITH + "SELECT node, CAST(depth AS BIGINT) AS depth FROM reach WHERE root = 'table:customer'")
_add("graph_impact_two_levels", _on_graph(lambda s, n, e: _without_root(traverse.blast_radius(n, e, _roots(s, "table:nation"), 2))), _WITH + "SELECT node, CAST(depth AS BIGINT) AS depth FROM reach WHERE root = 'table:nation' AND depth <= 2")
_add(
    "graph_column_impact",
    _on_graph(lambda s, n, e: _without_root(traverse.blast_radius(n, e, _roots(s, "column:customer.c_custkey")))),
    _WITH
    + """, second AS (SELECT 'table:customer' AS node, 1 AS depth UNION SELECT l.t, w.depth + 1 FROM second w JOIN links l ON l.f = w.node LEFT JOIN nodes n ON n.id = l.t
 WHERE w.depth < 12 AND NOT (l.type = 'CONTAINS' AND n.type = 'COLUMN' AND n.name <> 'c_custkey')),
 first AS (SELECT node, depth FROM reach WHERE root = 'column:customer.c_custkey')
SELECT node, CAST(depth AS BIGINT) AS depth FROM first UNION ALL SELECT node, CAST(min(depth) AS BIGINT) FROM second WHERE node <> 'column:customer.c_custkey' AND node NOT IN (SELECT node FROM first) GROUP BY node""",
)
_add("graph_upstream", _on_graph(lambda s, n, e: _without_root(traverse.upstream(e, _roots(s, "table:lineitem")))), _WITH + "SELECT root AS node, CAST(depth AS BIGINT) AS depth FROM reach WHERE node = 'table:lineitem'")
_add(
    "graph_hotspots",
    _on_graph(lambda s, n, e: traverse.hotspots(n, e, 10)),
    _WITH + "SELECT n.id, (SELECT count(*) FROM reach r WHERE r.root = n.id) AS blast, (SELECT count(*) FROM edges e WHERE e.src = n.id) + (SELECT count(*) FROM edges e WHERE e.dst = n.id) AS degree FROM nodes n WHERE n.type <> 'COLUMN' ORDER BY blast DESC, degree DESC, id LIMIT 10",
)
_add("graph_layers", _on_graph(lambda s, n, e: traverse.layers(n, e).select("id", F.col("layer").cast("long").alias("layer"))), _WITH + "SELECT n.id, CAST(coalesce((SELECT max(depth) FROM reach r WHERE r.node = n.id), 0) AS BIGINT) AS layer FROM nodes n")
_add("graph_roots", _on_graph(lambda s, n, e: traverse.ends(n, e, "roots")), _WITH + "SELECT id FROM nodes WHERE id NOT IN (SELECT t FROM links)")
_add("graph_leaves", _on_graph(lambda s, n, e: traverse.ends(n, e, "leaves")), _WITH + "SELECT id FROM nodes WHERE id NOT IN (SELECT f FROM links)")
_add(
    "graph_paths",
    _on_graph(lambda s, n, e: traverse.paths(e, "table:nation", "table:lineitem")),
    _WITH + ", p AS (SELECT ['table:nation'] AS path, 'table:nation' AS cur UNION ALL SELECT list_append(p.path, l.t), l.t FROM p JOIN (SELECT DISTINCT f, t FROM links) l ON l.f = p.cur WHERE NOT list_contains(p.path, l.t) AND len(p.path) <= 25 AND p.cur <> 'table:lineitem') SELECT array_to_string(path, ' > ') AS path, len(path) - 1 AS length FROM p WHERE cur = 'table:lineitem'",
)
_add("graph_find", _on_graph(lambda s, n, e: store.find(n, "NATION").select("id", "type")), _WITH + "SELECT id, type FROM nodes WHERE contains(id, 'nation')")
_add(
    "graph_resolve",
    _on_graph(lambda s, n, e: store.resolve(n, s.createDataFrame([("customer",), ("table:orders",), ("doc_id",), ("acctbal",), ("c_acctbal",), ("nothing",)], "ref string"))),
    _WITH + """, refs(ref) AS (VALUES ('customer'), ('table:orders'), ('doc_id'), ('acctbal'), ('c_acctbal'), ('nothing')),
hits AS (SELECT ref, id, CASE WHEN id = ref THEN 0 WHEN name = ref THEN 1 ELSE 4 END AS rank FROM refs JOIN nodes ON contains(id, ref) OR name = ref
  UNION ALL SELECT ref, id, 4 FROM refs JOIN nodes ON contains(id, ref) AND (id = ref OR name = ref)),
one AS (SELECT ref, rank, min(id) AS id FROM hits GROUP BY ref, rank HAVING count(*) = 1)
SELECT ref, (SELECT arg_min(id, rank) FROM one WHERE one.ref = refs.ref) AS id FROM refs""",
)
_add(
    "graph_subgraph",
    _on_graph(lambda s, n, e: store.subgraph(n, e, n.where("name in ('customer', 'orders', 'nation', 'c_custkey', 'o_custkey')").select("id"))[1].select("src", "dst", "type")),
    _WITH + ", pick AS (SELECT id FROM nodes WHERE name IN ('customer', 'orders', 'nation', 'c_custkey', 'o_custkey')) SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM pick) AND dst IN (SELECT id FROM pick)",
)


def _drift(spark: SparkSession, n: DataFrame, e: DataFrame) -> DataFrame:
    gone = F.col("id").contains("supplier")
    return store.drift((n, e), (n.where(~gone), e.where(~(F.col("src").contains("supplier") | F.col("dst").contains("supplier")))))


_add("graph_drift", _on_graph(_drift), _WITH + "SELECT CASE WHEN type = 'COLUMN' THEN 'column' ELSE 'node' END AS kind, 'removed' AS change, id AS key FROM nodes WHERE contains(id, 'supplier') UNION ALL SELECT 'edge', 'removed', src || ' ' || dst || ' ' || type FROM edges WHERE contains(src, 'supplier') OR contains(dst, 'supplier')")


def _merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as upserts of the user they are of: the first type, the last value."""
    e = _read(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("user:"), "user_id").alias("id"), F.col("event_type").alias("type"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("data_type"), F.lit(None).cast("boolean").alias("primary_key"), F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).alias("owner"), F.lit(None).cast("string").alias("description"), F.col("event_id").alias("seq"))
    return store.upsert_nodes(rows).select("id", "type", "owner")


_add("graph_merge_nodes", _merge_rows, "SELECT 'user:' || user_id AS id, arg_min(event_type, event_id) AS type, arg_max(CAST(event_id AS VARCHAR), event_id) FILTER (WHERE event_id % 3 <> 0) AS owner FROM events GROUP BY user_id")


def _merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.select(F.concat(F.lit("part:"), "l_partkey").alias("src"), F.concat(F.lit("supplier:"), "l_suppkey").alias("dst"), F.lit("DEPENDS_ON").alias("type"), F.when(F.col("l_returnflag") == "N", "extracted").when(F.col("l_returnflag") == "A", "inferred").otherwise("llm").alias("provenance"), F.lit(None).cast("string").alias("via"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return store.upsert_edges(rows.groupBy("src", "dst", "type", "seq").agg(F.min("provenance").alias("provenance"), F.min("via").alias("via"))).select("src", "dst", "provenance")


_add(
    "graph_merge_edges", _merge_edges,
    "WITH r AS (SELECT l_partkey AS p, l_suppkey AS s, l_orderkey * 10 + l_linenumber AS seq, min(CASE l_returnflag WHEN 'N' THEN 'extracted' WHEN 'A' THEN 'inferred' ELSE 'llm' END) AS v FROM lineitem GROUP BY ALL) SELECT 'part:' || p AS src, 'supplier:' || s AS dst, CASE WHEN arg_min(v, seq) = 'inferred' AND bool_or(v = 'extracted') THEN 'extracted' ELSE arg_min(v, seq) END AS provenance FROM r GROUP BY p, s",
)


def _aliases(spark: SparkSession, n: DataFrame, e: DataFrame) -> DataFrame:
    longer = spark.createDataFrame([("table:prod.sales.orders", "TABLE", "orders"), ("table:prod.nation", "TABLE", "nation"), ("table:test.nation", "TABLE", "nation"), ("table:sales.orders", "VIEW", "orders")], "id string, type string, name string")
    return store.alias_links(n.select("id", "type", "name").union(longer))


_add("graph_alias_links", _on_graph(_aliases), _WITH + """, t AS (SELECT id FROM nodes WHERE type = 'TABLE' UNION ALL SELECT * FROM (VALUES ('table:prod.sales.orders'), ('table:prod.nation'), ('table:test.nation'), ('table:sales.orders'))),
l AS (SELECT a.id AS short, b.id AS long FROM t a JOIN t b ON ends_with(b.id, '.' || substr(a.id, 7)))
SELECT short, min(long) AS long FROM l GROUP BY short HAVING count(*) = 1""")


def _instance_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of rows: what a change of each nation reaches, as counts by kind. Edges are the foreign keys themselves."""
    c, o, l = (_read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))  # noqa: E741
    lines = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    orders = o.select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.sum("lines").alias("lines"))
    each = c.select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("nation"))
    return each.agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


_add("graph_instance_impact", _instance_impact, "SELECT c_nationkey AS nation, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_nationkey")

# --- analysis ----------------------------------------------------------------------------------------------------------------
_add(
    "impact_risk", _on_graph(lambda s, n, e: analysis.risk(traverse.blast_radius(n, e, _roots(s, "table:customer")).select("node", "depth"), n)),
    _WITH + ", a AS (SELECT r.depth, n.type FROM reach r JOIN nodes n ON n.id = r.node WHERE root = 'table:customer'), x AS (SELECT sum(CASE type WHEN 'TABLE' THEN 3 ELSE 1 END * greatest(0.5, 1 - 0.1 * (depth - 1))) + least(count(*) FILTER (WHERE depth = 1), 10) AS s, count(*) AS affected FROM a) SELECT CAST(round(s, 1) AS DOUBLE) AS score, CASE WHEN s >= 40 THEN 'CRITICAL' WHEN s >= 18 THEN 'HIGH' WHEN s >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS level, affected FROM x",
)
_add("impact_by_type", _on_graph(lambda s, n, e: analysis.by_type(traverse.blast_radius(n, e, _roots(s, "table:region")), n)), _WITH + "SELECT n.type, count(*) AS n FROM reach r JOIN nodes n ON n.id = r.node WHERE r.root = 'table:region' GROUP BY n.type")
_add(
    "relationships_tables", _on_graph(lambda s, n, e: analysis.relationships(n, e)),
    _WITH + "SELECT id, coalesce((SELECT string_agg(c.name, ',' ORDER BY c.name) FROM nodes c WHERE c.parent = n.id), '') AS columns, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM edges e WHERE e.src = n.id AND e.type = 'DEPENDS_ON'), '') AS depends_on, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM edges e WHERE e.dst = n.id AND e.type = 'DEPENDS_ON'), '') AS dependents FROM nodes n WHERE type = 'TABLE'",
)
_add("relationships_columns", _on_graph(lambda s, n, e: e.where("type = 'DEPENDS_ON' and src like 'column:%'").select("src", "dst", "via")), _WITH + "SELECT src, dst, 'foreign_key' AS via FROM edges WHERE type = 'DEPENDS_ON' AND src LIKE 'column:%'")
_add(
    "search_ranked", _on_graph(lambda s, n, e: analysis.search(n, "nation")),
    _WITH + "SELECT id, CAST(s AS INTEGER) AS score FROM (SELECT n.id, CASE WHEN name = 'nation' THEN 100 WHEN starts_with(name, 'nation') THEN 80 WHEN contains(name, 'nation') THEN 60 WHEN contains(n.id, 'nation') THEN 50 WHEN n.id IN (SELECT parent FROM nodes WHERE type = 'COLUMN' AND contains(name, 'nation')) THEN 40 ELSE 0 END AS s FROM nodes n WHERE type <> 'COLUMN') WHERE s > 0 ORDER BY s DESC, id LIMIT 20",
)
_add("pii_columns", _on_graph(lambda s, n, e: n.where("type = 'COLUMN'").where(text.is_sensitive(F.col("name"))).select("id")), _WITH + f"SELECT id FROM nodes WHERE type = 'COLUMN' AND {_sensitive_sql('name')}")
_add(
    "pii_exposure", _on_graph(lambda s, n, e: analysis.exposure(n, e).drop("owner")),
    _WITH + f"SELECT parent AS id, string_agg(name, ',' ORDER BY name) AS sensitive, (SELECT count(*) FROM reach r JOIN nodes m ON m.id = r.node WHERE r.root = c.parent AND m.type <> 'COLUMN') AS downstream, CAST(0 AS BIGINT) AS exposed FROM nodes c WHERE type = 'COLUMN' AND {_sensitive_sql('name')} GROUP BY parent",
)

_add(
    "pii_totals", _on_graph(lambda s, n, e: analysis.exposure_totals(analysis.exposure(n, e))),
    _WITH + f", c AS (SELECT parent, count(*) AS k FROM nodes WHERE type = 'COLUMN' AND {_sensitive_sql('name')} GROUP BY parent) SELECT count(*) AS assets, CAST(sum(k) AS BIGINT) AS columns, CAST(0 AS BIGINT) AS exposed_assets, count(*) AS unowned FROM c",
)
_add(
    "search_facets", _on_graph(lambda s, n, e: analysis.search(n.withColumns({"terms": F.when(F.col("name").startswith("o"), F.array(F.lit("Nation rule"))), "domain": F.substring("name", 1, 1)}), "nation", 50, kind="table")),
    _WITH + "SELECT id, CAST(s AS INTEGER) AS score FROM (SELECT n.id, CASE WHEN name = 'nation' THEN 100 WHEN starts_with(name, 'nation') THEN 80 WHEN contains(name, 'nation') THEN 60 WHEN n.id IN (SELECT parent FROM nodes WHERE type = 'COLUMN' AND contains(name, 'nation')) THEN 40 WHEN starts_with(name, 'o') THEN 28 ELSE 0 END AS s FROM nodes n WHERE type = 'TABLE') WHERE s > 0",
)
_add("relationships_column_pairs", _on_graph(lambda s, n, e: analysis.column_relationships(n, e, "order").drop("via")), _WITH + "SELECT 'table:' || c AS from_table, cc AS from_column, 'table:' || p AS to_table, pc AS to_column FROM fk WHERE contains(c || cc || p || pc, 'order')")

# --- usage: the events table as a query log ------------------------------------------------------------------------------------
_USAGE = "u AS (SELECT lower(event_type) AS object_name, count(*) AS queries, max(ts) AS last_query FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY ALL)"


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _read(spark, sf_dir, "events").select(F.col("event_type").alias("object_name"), "ts")
    return usage.usage_counts(log, 30)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("table:click",), ("table:purchase",), ("table:nothing",)], "id string")
    return usage.on_tables(names, _usage(spark, sf_dir).withColumn("object_name", F.concat(F.lit("web."), "object_name")))


_MEASURED = "t(id) AS (VALUES ('table:click'), ('table:purchase'), ('table:nothing')), m AS (SELECT t.id, coalesce(sum(queries), 0) AS queries FROM t LEFT JOIN u ON 'table:' || object_name = t.id GROUP BY t.id)"
_add("usage_window", lambda s, d: _usage(s, d).select("object_name", "queries", F.date_format("last_query", "yyyy-MM-dd HH:mm:ss").alias("last_query")), f"WITH {_USAGE} SELECT object_name, queries, strftime(last_query, '%Y-%m-%d %H:%M:%S') AS last_query FROM u")
_add("usage_counts", lambda s, d: _measured(s, d).select("id", "queries"), f"WITH {_USAGE}, {_MEASURED} SELECT id, CAST(queries AS BIGINT) AS queries FROM m")
_add("usage_unused", lambda s, d: usage.unused(_measured(s, d), s.createDataFrame([("table:click", 2)], "id string, n long")), f"WITH {_USAGE}, {_MEASURED} SELECT id, id <> 'table:click' AS safe_to_drop FROM m WHERE queries = 0")


# --- text --------------------------------------------------------------------------------------------------------------------
_add("text_sanitize", lambda s, d: _read(s, d, "documents").select("doc_id", text.sanitize(F.col("text"), 200).alias("clean")), "SELECT doc_id, CASE WHEN length(c) > 200 THEN left(c, 199) || '…' ELSE c END AS clean FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{200B}-\\x{200F}\\x{2028}\\x{2029}\\x{202A}-\\x{202E}\\x{FEFF}]', '', 'g') AS c FROM documents)")
_add(
    "text_redact", lambda s, d: _read(s, d, "customer").select("c_custkey", text.redact_dsn(F.concat(F.lit("postgres://user"), "c_custkey", F.lit(":p@w"), "c_custkey", F.lit("@host:5432/db?password=x"))).alias("dsn")),
    "SELECT c_custkey, 'postgres://user' || c_custkey || ':***@host:5432/db' AS dsn FROM customer",
)
_add(
    "text_clean_names", lambda s, d: _read(s, d, "pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.quote_identifier(F.col("url")).alias("quoted"), text.escape_literal(F.concat("url", F.lit("'"))).alias("literal"), text.escape_script_json(F.concat("url", F.lit("</x><!--"))).alias("script")),
    """SELECT page_id, left(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 150) AS slug, '"' || replace(url, '"', '""') || '"' AS quoted, replace(url || '''', '''', '''''') AS literal, replace(replace(url || '</x><!--', '</', '<\\/'), '<!--', '<\\!--') AS script FROM pages""",
)
_add(
    "code_sql_tables", lambda s, d: code.sql_tables(_read(s, d, "documents").select("doc_id", F.concat(F.lit("select a from t"), F.col("doc_id"), F.lit(" join s.u on 1=1; insert into w"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, " values (?)").otherwise(" select 1")).alias("q")), "q").select("doc_id", F.array_join(F.sort_array("reads"), ",").alias("reads"), F.array_join("writes", ",").alias("writes"), "certain"),
    "SELECT doc_id, 's.u,t' || doc_id AS reads, 'w' || doc_id AS writes, doc_id % 2 <> 0 AS certain FROM documents",
)
_add("text_sql_detect", lambda s, d: _read(s, d, "conversations").select("conv_id", "turn", text.looks_like_sql(F.col("text")).alias("is_sql")), "SELECT conv_id, turn, length(text) >= 12 AND regexp_matches(text, '(?i)\\b(select|insert|update|delete|merge|create|with)\\b') AND regexp_matches(text, '(?i)\\b(from|into|join|update|table)\\s+[A-Za-z_{\"`\\[]') AS is_sql FROM conversations")

# --- more of the graph -----------------------------------------------------------------------------------------------------------
_add("graph_lookup", _on_graph(lambda s, n, e: store.lookup(n, ["table:orders", "column:orders.o_custkey", "table:none"]).select("id", "name")), _WITH + "SELECT id, name FROM nodes WHERE id IN ('table:orders', 'column:orders.o_custkey')")
_add("graph_by_type", _on_graph(lambda s, n, e: store.of_type(n, "TABLE").select("id")), _WITH + "SELECT id FROM nodes WHERE type = 'TABLE'")
_add("graph_incident_edges", _on_graph(lambda s, n, e: store.incident(e, "table:customer").select("src", "dst", "type", "side")), _WITH + "SELECT src, dst, type, 'out' AS side FROM edges WHERE src = 'table:customer' UNION ALL SELECT src, dst, type, 'in' FROM edges WHERE dst = 'table:customer'")
_add(
    "graph_lineage", _on_graph(lambda s, n, e: traverse.lineage(n, e, _roots(s, "table:orders")).select("direction", "node", F.col("depth").cast("long").alias("depth"))),
    _WITH + "SELECT 'down' AS direction, node, CAST(depth AS BIGINT) AS depth FROM reach WHERE root = 'table:orders' UNION ALL SELECT 'up', root, CAST(depth AS BIGINT) FROM reach WHERE node = 'table:orders'",
)
for _way, _from, _to in (("down", "root", "node"), ("up", "node", "root")):
    _add(
        f"graph_tree_{_way}", _on_graph(lambda s, n, e, w=_way: traverse.tree(e, "table:orders", w).select("node", F.col("depth").cast("long").alias("depth"), "parent")),
        _WITH + f", r AS (SELECT {_to} AS node, depth FROM reach WHERE {_from} = 'table:orders' UNION ALL SELECT 'table:orders', 0), s AS (SELECT {'f, t' if _way == 'down' else 't AS f, f AS t'} FROM links) SELECT r.node, CAST(r.depth AS BIGINT) AS depth, min(p.node) AS parent FROM r JOIN s ON s.t = r.node JOIN r p ON p.node = s.f AND p.depth = r.depth - 1 GROUP BY ALL",
    )
_add(
    "graph_missing_endpoints", _on_graph(lambda s, n, e: store.with_missing_endpoints(n.where("type = 'TABLE'"), e).where("seq is null").select("id", "type", "name")),
    _WITH + "SELECT DISTINCT x AS id, 'COLUMN' AS type, substr(x, 8) AS name FROM (SELECT src AS x FROM edges UNION ALL SELECT dst FROM edges) WHERE x LIKE 'column:%'",
)
_add("graph_merge", _on_graph(lambda s, n, e: store.merge((n, e), (n.withColumns({"type": F.lit("VIEW"), "owner": F.lit("me")}), e))[0].select("id", "type", "owner")), _WITH + "SELECT id, type, 'me' AS owner FROM nodes")
_add("sink_dot", _on_graph(lambda s, n, e: sinks.dot_lines(n, e).select("line")), _WITH + r"""SELECT '  "' || id || '" [label="' || name || '\n(' || lower(type) || ')"];' AS line FROM nodes UNION ALL SELECT '  "' || src || '" -> "' || dst || '" [label="' || lower(type) || '"];' FROM edges""")
_add("sink_cypher", _on_graph(lambda s, n, e: sinks.cypher_lines(n, e).select("line")), _WITH + """SELECT 'MERGE (n:' || upper(type[1]) || lower(type[2:]) || ' {id: ''' || id || '''}) SET n.name = ''' || name || ''';' AS line FROM nodes UNION ALL SELECT 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) MERGE (a)-[:' || type || ' {provenance: ''extracted''}]->(b);' FROM edges""")
_add("sink_plain_edges", _on_graph(lambda s, n, e: sinks.plain_edges(e).select("src", "dst", "type")), _WITH + "SELECT DISTINCT src, dst, type FROM edges")

# --- what follows from a change --------------------------------------------------------------------------------------------------
_HIT = _WITH + ", hit AS (SELECT n.*, r.depth FROM reach r JOIN nodes n ON n.id = r.node WHERE root = 'table:customer') "
_change = lambda s, n, e, **k: impact.analyse(s, n, e, ["customer", "table:customer", "none of it"], **k)
_add("impact_tests", _on_graph(lambda s, n, e: _change(s, n, e).tests.select("test")), _HIT + "SELECT DISTINCT CASE type WHEN 'TABLE' THEN 'Check the schema contract of ' || name || ' (column names, types)' ELSE 'Test column ''' || name || ''' of ' || parent || ' for nulls and relationships' END AS test FROM hit")
_add("impact_owners", _on_graph(lambda s, n, e: _change(s, n.withColumn("owner", F.concat(F.lit("team "), F.substring("name", 1, 1))), e).owners.select("owner", F.array_join("assets", ",").alias("assets"))), _HIT + "SELECT 'team ' || name[1] AS owner, string_agg(DISTINCT name, ',' ORDER BY name) AS assets FROM hit GROUP BY 1")
_add(
    "impact_warnings", _on_graph(lambda s, n, e: _change(s, n, e, deprecated=n.select("id", F.col("name").alias("reason"), F.lit(None).cast("string").alias("replacement")), statuses=n.select("id", F.length("name").cast("long").alias("tests_failed"), F.array("type").alias("failing_tests"), F.when(F.col("type") == "TABLE", "warn").alias("freshness"), F.lit(None).cast("string").alias("max_loaded_at"))).warnings),
    _HIT + ", both_ AS (SELECT id, name, type FROM hit UNION SELECT id, name, type FROM nodes WHERE id = 'table:customer') SELECT id, '''' || name || ''' is deprecated (' || name || ')' AS warning FROM hit UNION ALL SELECT id, '''' || name || ''' has ' || length(name) || ' failing tests: ' || type FROM both_ UNION ALL SELECT id, 'freshness of ''' || name || ''': warn' FROM both_ WHERE type = 'TABLE'",
)

# --- governance ------------------------------------------------------------------------------------------------------------------
_DOCUMENT = {
    "glossary": [{"term": "Customer", "definition": "who buys", "applies_to": ["table:cust*", "column:*.?_custkey", "missing"]}, {"term": "Order", "applies_to": ["table:orders"]}],
    "domains": [{"name": "Sales", "assets": ["table:*[rs]"], "owner": "sales"}, {"name": "Places", "assets": ["table:region", "nation"]}],
    "deprecations": [{"asset": "table:nation", "reason": "old"}, {"asset": "table:gone"}], "owners": {"table:region": "geo"},
}
_ATTACHED = _WITH + """, said(kind, ref, value, seq) AS (VALUES ('term', 'table:cust*', 'Customer', 0), ('term', 'column:*.?_custkey', 'Customer', 1), ('term', 'table:orders', 'Order', 3), ('domain', 'table:*[rs]', 'Sales', 4), ('domain', 'table:region', 'Places', 5), ('domain', 'table:nation', 'Places', 6), ('deprecated', 'table:nation', NULL, 7), ('owner', 'table:region', 'geo', 9)),
att AS (SELECT kind, value, seq, id FROM said JOIN nodes ON id GLOB ref) """


def _governed(spark: SparkSession, n: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = governance.attachments(spark, _DOCUMENT)
    return rows, governance.attached(rows, n)


_add("governance_attached", _on_graph(lambda s, n, e: _governed(s, n)[1].select("kind", "id", "value")), _ATTACHED + "SELECT kind, id, value FROM att")
_add("governance_unmatched", _on_graph(lambda s, n, e: governance.unmatched(*_governed(s, n))), _WITH + ", said(kind, value, ref) AS (VALUES ('term', 'Customer', 'missing'), ('term', 'Order', 'table:orders'), ('deprecated', NULL, 'table:gone'), ('deprecated', NULL, 'table:nation')) SELECT * FROM said WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE id = ref OR contains(id, ref))")
_add("governance_assets", _on_graph(lambda s, n, e: governance.governed(n, _governed(s, n)[1]).select("id", "owner", "domain")), _ATTACHED + ", d AS (SELECT id, arg_max(value, seq) AS domain, bool_or(value = 'Sales') AS sales FROM att WHERE kind = 'domain' GROUP BY id) SELECT n.id, coalesce((SELECT value FROM att WHERE att.id = n.id AND kind = 'owner'), CASE WHEN sales THEN 'sales' END) AS owner, domain FROM nodes n LEFT JOIN d ON d.id = n.id")
_add("governance_glossary", _on_graph(lambda s, n, e: governance.glossary(*_governed(s, n)).select("term", F.array_join("assets", ",").alias("assets"))), _ATTACHED + "SELECT value AS term, string_agg(DISTINCT id, ',' ORDER BY id) AS assets FROM att WHERE kind = 'term' GROUP BY value")
_add("governance_domains", _on_graph(lambda s, n, e: governance.domains(governance.governed(n, _governed(s, n)[1])).select("domain", F.array_join("assets", ",").alias("assets"))), _ATTACHED + ", d AS (SELECT id, arg_max(value, seq) AS domain FROM att WHERE kind = 'domain' GROUP BY id) SELECT domain, string_agg(id, ',' ORDER BY id) AS assets FROM d GROUP BY domain")
_add("governance_still_used", _on_graph(lambda s, n, e: governance.still_used(governance.deprecated(_governed(s, n)[1]), n, e)), _ATTACHED + "SELECT id, (SELECT count(*) FROM reach r WHERE r.root = att.id AND r.node NOT LIKE 'column:%') AS users FROM att WHERE kind = 'deprecated'")

# --- modelling -------------------------------------------------------------------------------------------------------------------
_singular = lambda x: f"CASE WHEN {x} LIKE '%ies' THEN {x}[:-4] || 'y' WHEN {x} LIKE '%ses' OR {x} LIKE '%xes' THEN {x}[:-3] WHEN {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN {x}[:-2] ELSE {x} END"
_MODEL = f"""WITH fk(ft, fc, tt, tc) AS (VALUES {", ".join(str(k) for k in KEYS)}),
cols AS (SELECT DISTINCT table_name AS t, lower(column_name) AS c, lower(data_type) AS k FROM information_schema.columns WHERE table_name IN ({_names})),
base AS (SELECT t, regexp_replace(t, '^({"|".join(model.PREFIXES)})', '') AS b FROM (SELECT DISTINCT t FROM cols)),
one AS (SELECT t, b, {_singular("b")} AS s FROM base),
roles AS (SELECT cols.t, c, CASE
  WHEN c IN ('id', 'pk', b || '_id', s || '_id', b || '_key', s || '_key', s || '_sk', b || '_sk') THEN 'pk'
  WHEN regexp_matches(c, '{model.KEY_LIKE}') THEN CASE WHEN regexp_matches(c, '{model.CODE_LIKE}') THEN 'attribute' ELSE 'fk' END
  WHEN regexp_matches(k, '{model.BOOLEAN_START}') OR regexp_matches(c, '{model.FLAG_NAME}') THEN 'flag'
  WHEN regexp_matches(k, '{model.DATE_TYPE}') OR regexp_matches(c, '{model.DATE_NAME}') THEN 'date'
  WHEN regexp_matches(k, '{model.NUMERIC_TYPE}') THEN 'measure' ELSE 'attribute' END AS role FROM cols JOIN one USING (t)),
asked AS (SELECT cols.t AS ft, c AS fc, regexp_extract(c, '{model.KEY_NAME}', 1) AS ref FROM cols JOIN one USING (t) WHERE regexp_matches(c, '{model.KEY_NAME}') AND regexp_extract(c, '{model.KEY_NAME}', 1) NOT IN (b, s)),
guess AS (SELECT DISTINCT ft, fc, ref, one.t AS tt FROM asked JOIN one ON (ref IN (b, s) OR {_singular("ref")} IN (b, s)) AND one.t <> ft),
best AS (SELECT *, row_number() OVER (PARTITION BY ft, fc ORDER BY CASE WHEN EXISTS (SELECT 1 FROM cols WHERE t = tt AND c IN (fc, 'id', ref || '_id')) THEN 0 ELSE 1 END, tt) AS r FROM guess),
links AS (SELECT ft, fc, tt, tc, 'extracted' AS provenance FROM fk UNION ALL SELECT ft, fc, tt, CASE WHEN EXISTS (SELECT 1 FROM cols WHERE t = tt AND c = fc) THEN fc ELSE 'id' END, 'inferred' FROM best WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM fk WHERE fk.ft = best.ft AND fk.fc = best.fc AND fk.tt = best.tt)),
n AS (SELECT t, {", ".join(f"CAST(count(*) FILTER (WHERE role = '{r}') AS DOUBLE) AS {r}_" for r in model.ROLES)}, CAST((SELECT count(*) FROM links WHERE ft = t) AS DOUBLE) AS fo, CAST((SELECT count(*) FROM links WHERE tt = t) AS DOUBLE) AS fi FROM roles GROUP BY t),
score AS (SELECT *, 2 * fo + 1.5 * measure_ + CASE WHEN date_ > 0 THEN 1 ELSE 0 END + CASE WHEN fo = 0 THEN fk_ ELSE 0 END + CASE WHEN regexp_matches(t, '{model.FACT_NAME}') THEN 2 ELSE 0 END AS f,
  2 * fi + 0.75 * attribute_ + CASE WHEN pk_ > 0 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, '{model.DIMENSION_NAME}') THEN 2 ELSE 0 END AS d FROM n),
classes AS (SELECT *, CASE WHEN (fo >= 2 OR fk_ >= 2) AND measure_ + attribute_ + date_ = 0 THEN 'bridge' WHEN f = 0 AND d = 0 THEN 'unknown' WHEN f > d THEN 'fact'
  WHEN d > f THEN CASE WHEN measure_ >= 2 AND fi = 0 AND f >= 0.8 * d THEN 'fact' ELSE 'dimension' END WHEN attribute_ > 0 AND measure_ = 0 THEN 'lookup' ELSE 'unknown' END AS role,
  CASE WHEN (fo >= 2 OR fk_ >= 2) AND measure_ + attribute_ + date_ = 0 THEN 0.8 WHEN f = 0 AND d = 0 THEN 0 WHEN f = d THEN 0.3 ELSE least(1, round(abs(f - d) / greatest(f, d, 1) * 0.6 + 0.4, 2)) END AS confidence FROM score) """


def _model(spark: SparkSession, n: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """roles, classes, links of the catalogue."""
    tables, columns = n.where("type = 'TABLE'"), n.where("type = 'COLUMN'")
    links, roles = model.key_links(tables, columns, e), model.column_roles(columns, tables)
    return roles, model.table_roles(tables, roles, links), links


_add("model_column_roles", _on_graph(lambda s, n, e: _model(s, n, e)[0].select("id", "role")), _MODEL + "SELECT 'column:' || t || '.' || c AS id, role FROM roles")
_add("model_key_links", _on_graph(lambda s, n, e: _model(s, n, e)[2]), _MODEL + "SELECT 'table:' || ft AS from_table, fc AS from_column, 'table:' || tt AS to_table, tc AS to_column, provenance FROM links")
_add("model_table_roles", _on_graph(lambda s, n, e: _model(s, n, e)[1].select("id", "role", "confidence")), _MODEL + "SELECT 'table:' || t AS id, role, CAST(confidence AS DOUBLE) AS confidence FROM classes")
_add("model_conformed", _on_graph(lambda s, n, e: (lambda r, c, l: model.conformed(l, c.where("role in ('fact', 'bridge')")))(*_model(s, n, e))), _MODEL + "SELECT 'table:' || tt AS id, count(DISTINCT ft) AS facts FROM links WHERE ft IN (SELECT t FROM classes WHERE role IN ('fact', 'bridge')) GROUP BY tt HAVING count(DISTINCT ft) >= 2")
_add("model_facts", _on_graph(lambda s, n, e: model.facts(*_model(s, n, e)).select("id", F.array_join("measures", ",").alias("measures"), F.array_join("dimensions", ",").alias("dimensions"), F.array_join("grain", ",").alias("grain"))), _MODEL + "SELECT 'table:' || t AS id, coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM roles r WHERE r.t = classes.t AND r.role = 'measure'), '') AS measures, coalesce((SELECT string_agg(DISTINCT 'table:' || tt, ',' ORDER BY 'table:' || tt) FROM links WHERE ft = t), '') AS dimensions, concat_ws(',', (SELECT min(c) FROM roles r WHERE r.t = classes.t AND r.role = 'date'), (SELECT string_agg(DISTINCT fc, ',' ORDER BY fc) FROM links WHERE ft = t)) AS grain FROM classes WHERE role IN ('fact', 'bridge')")
_add("model_dimensions", _on_graph(lambda s, n, e: model.dimensions(*_model(s, n, e)).select("id", "key", F.array_join("attributes", ",").alias("attributes"), "scd_type")), _MODEL + "SELECT 'table:' || t AS id, (SELECT min(c) FROM roles r WHERE r.t = classes.t AND r.role = 'pk') AS key, coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM roles r WHERE r.t = classes.t AND r.role IN ('attribute', 'flag', 'date')), '') AS attributes, 'undecided' AS scd_type FROM classes WHERE role IN ('dimension', 'lookup')")
_add("model_additivity", _on_graph(lambda s, n, e: model.additivity(model.facts(*_model(s, n, e)))), _MODEL + f"SELECT 'table:' || t AS id, c AS measure, CASE WHEN regexp_matches(c, '{'|'.join(model.SEMI_ADDITIVE)}') THEN 'semi-additive' ELSE 'additive' END AS kind FROM roles WHERE role = 'measure' AND t IN (SELECT t FROM classes WHERE role IN ('fact', 'bridge'))")
_add("model_issue_dates", _on_graph(lambda s, n, e: model.issues(*_model(s, n, e)).where("rule = 'fact without date'").select("id")), _MODEL + "SELECT 'table:' || t AS id FROM classes WHERE role IN ('fact', 'bridge') AND date_ = 0")

# --- lineage of SQL: statements made from the catalogue ----------------------------------------------------------------------------
_COLS = f"WITH cols AS (SELECT DISTINCT table_name AS t, lower(column_name) AS c FROM information_schema.columns WHERE table_name IN ({_names})), fk(ft, fc, tt, tc) AS (VALUES {', '.join(str(k) for k in KEYS)}) "


def _schema(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    return {t: [c.lower() for c in _read(spark, sf_dir, t).columns] for t in TABLES}


def _statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A file a table: a view of all its columns under other names, and a table made of each foreign key's join."""
    shape, files = _schema(spark, sf_dir), []
    for t, columns in shape.items():
        shown = ", ".join(f"upper(x.`{c}`) AS new_{c}" for c in columns)
        text_ = f"-- {t}; first\nCREATE VIEW mart.v_{t} AS WITH x AS (SELECT * FROM {t}) SELECT {shown} FROM x;\n"
        for ft, fc, tt, tc in KEYS:
            if ft == t:
                text_ += f"CREATE TABLE mart.{ft}_{fc} AS SELECT a.{fc} AS k, count(b.{tc}) AS n FROM {ft} a JOIN {tt} b ON a.{fc} = b.{tc} GROUP BY a.{fc};\nINSERT INTO mart.all_keys SELECT {fc} FROM {ft};"
        files.append((f"{t}.sql", text_ + "THIS IS NOT SQL;"))
    return sql.statements_graph(spark, files, shape)


_add("lineage_sql_tables", lambda s, d: _statements(s, d)[1].where("type = 'DEPENDS_ON' and src like 'table:%'").select("src", "dst").distinct(), _COLS + "SELECT DISTINCT 'table:mart.v_' || t AS src, 'table:' || t AS dst FROM cols UNION SELECT 'table:mart.' || ft || '_' || fc, 'table:' || x FROM (SELECT ft, fc, unnest([ft, tt]) AS x FROM fk) UNION SELECT 'table:mart.all_keys', 'table:' || ft FROM fk")
_add("lineage_sql_columns", lambda s, d: _statements(s, d)[1].where("type = 'DEPENDS_ON' and src like 'column:%'").select("src", "dst").distinct(), _COLS + "SELECT 'column:mart.v_' || t || '.new_' || c AS src, 'column:' || t || '.' || c AS dst FROM cols UNION SELECT 'column:mart.' || ft || '_' || fc || '.k', 'column:' || ft || '.' || fc FROM fk UNION SELECT 'column:mart.' || ft || '_' || fc || '.n', 'column:' || tt || '.' || tc FROM fk UNION SELECT 'column:mart.all_keys.' || fc, 'column:' || ft || '.' || fc FROM fk")
_add("lineage_sql_files", lambda s, d: _statements(s, d)[1].where("src like 'file:%'").select("src", "dst", "type"), _COLS + "SELECT DISTINCT 'file:' || t || '.sql' AS src, 'table:mart.v_' || t AS dst, 'CONTAINS' AS type FROM cols UNION ALL SELECT 'file:' || ft || '.sql', 'table:mart.' || ft || '_' || fc, 'CONTAINS' FROM fk")
_add("lineage_sql_unparsed", lambda s, d: _statements(s, d)[2].select("path", "sql"), _COLS + "SELECT DISTINCT t || '.sql' AS path, 'THIS IS NOT SQL' AS sql FROM cols")


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    shape = _schema(spark, sf_dir)
    return sql.views_graph(spark, [(f"table:v.{t}", f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {c[0]}) AS place FROM {t}) q UNION ALL SELECT *, 0 FROM {t}") for t, c in shape.items()], shape)


_add("lineage_views", lambda s, d: _views(s, d)[1].where("type = 'DEPENDS_ON'").select("src", "dst", "via").distinct(), _COLS + "SELECT 'column:v.' || t || '.' || c AS src, 'column:' || t || '.' || c AS dst, 'sql' AS via FROM cols UNION SELECT 'table:v.' || t, 'table:' || t, 'view_definition' FROM cols")


# --- dbt: a manifest made from the catalogue ---------------------------------------------------------------------------------------
def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tables as sources, a model a table that depends on its source and on the models of its foreign keys, a test a model, one exposure; and a run."""
    import json

    shape = _schema(spark, sf_dir)
    sources = {f"source.p.raw.{t}": {"name": t, "source_name": "raw", "schema": "raw", "columns": {c: {"name": c, "data_type": "x"} for c in cs}} for t, cs in shape.items()}
    nodes = {
        f"model.p.m_{t}": {"resource_type": "model", "name": f"m_{t}", "schema": "mart", "database": "db", "original_file_path": f"models/{t}.sql", "config": {"materialized": "view"}, "compiled_code": f"SELECT {', '.join(f'{c} AS n_{c}' for c in cs)} FROM raw.{t}", "depends_on": {"nodes": [f"source.p.raw.{t}", *(f"model.p.m_{p}" for ch, _, p, _ in KEYS if ch == t)]}}
        for t, cs in shape.items()
    }
    nodes |= {f"test.p.t_{t}": {"resource_type": "test", "name": f"t_{t}", "depends_on": {"nodes": [f"model.p.m_{t}"]}} for t in shape}
    shown = {"exposure.p.board": {"name": "board", "type": "dashboard", "depends_on": {"nodes": ["model.p.m_orders", "source.p.raw.other"]}}}
    run = {"metadata": {"generated_at": "2026-01-01"}, "results": [{"unique_id": f"test.p.t_{t}", "status": "fail" if t.startswith("l") else "pass"} for t in shape] + [{"unique_id": "model.p.m_orders", "status": "success", "execution_time": 1.23456}]}
    read = lambda document, schema: spark.createDataFrame([(json.dumps(document),)], "j string").select(F.from_json("j", schema).alias("d")).select("d.*")
    return read({"nodes": nodes, "sources": sources, "exposures": shown}, dbt.MANIFEST), read(run, dbt.RESULTS)


_add("dbt_nodes", lambda s, d: dbt.graph(_manifest(s, d)[0])[0].where("type <> 'COLUMN'").select("id", "type"), _COLS + ", t AS (SELECT DISTINCT t FROM cols) SELECT 'dbt:m_' || t AS id, 'DBT_MODEL' AS type FROM t UNION ALL SELECT 'source:raw.' || t, 'DBT_SOURCE' FROM t UNION ALL SELECT 'file:models/' || t || '.sql', 'FILE' FROM t UNION ALL SELECT 'table:db.mart.m_' || t, 'VIEW' FROM t UNION ALL SELECT 'exposure:board', 'DASHBOARD'")
_add("dbt_edges", lambda s, d: dbt.graph(_manifest(s, d)[0])[1].select("src", "dst", "type"), _COLS + ", t AS (SELECT DISTINCT t FROM cols) SELECT 'dbt:m_' || t AS src, 'source:raw.' || t AS dst, 'DEPENDS_ON' AS type FROM t UNION SELECT 'dbt:m_' || ft, 'dbt:m_' || tt, 'DEPENDS_ON' FROM fk UNION SELECT 'file:models/' || t || '.sql', 'dbt:m_' || t, 'CONTAINS' FROM t UNION SELECT 'dbt:m_' || t, 'table:db.mart.m_' || t, 'WRITES_TO' FROM t UNION SELECT 'source:raw.' || t, 'column:raw.' || t || '.' || c, 'CONTAINS' FROM cols UNION SELECT * FROM (VALUES ('dbt:m_orders', 'exposure:board', 'EXPOSES'), ('source:raw.other', 'exposure:board', 'EXPOSES'))")
_add("dbt_statuses", lambda s, d: dbt.statuses(*_manifest(s, d)).select("gid", "tests_passed", "tests_failed", F.array_join("failing_tests", ",").alias("failing_tests"), "state"), _COLS + "SELECT DISTINCT 'dbt:m_' || t AS gid, CASE WHEN t LIKE 'l%' THEN 0 ELSE 1 END AS tests_passed, CASE WHEN t LIKE 'l%' THEN 1 ELSE 0 END AS tests_failed, CASE WHEN t LIKE 'l%' THEN 't_' || t ELSE '' END AS failing_tests, CASE WHEN t = 'orders' THEN 'success' END AS state FROM cols")
_add("dbt_column_lineage", lambda s, d: dbt.column_lineage(s, _manifest(s, d)[0])[0].select("src", "dst"), _COLS + "SELECT 'column:m_' || t || '.n_' || c AS src, 'column:raw.' || t || '.' || c AS dst FROM cols")
_add("dbt_relations", lambda s, d: dbt.resolved(s.createDataFrame([("x.db.mart.M_ORDERS",), ("mart.m_part",), ("other.m_nation",), ("raw.region",), ("none",)], "name string"), dbt.relations(dbt.resources(_manifest(s, d)[0]))), "SELECT * FROM (VALUES ('x.db.mart.M_ORDERS', 'dbt:m_orders'), ('mart.m_part', 'dbt:m_part'), ('other.m_nation', 'dbt:m_nation'), ('raw.region', 'source:raw.region')) t(name, gid)")


# --- information schema ------------------------------------------------------------------------------------------------------------
def _information(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """tables, columns, constraints, key usage as a database would list them, its own objects included."""
    shape = _schema(spark, sf_dir)
    place = lambda t: ("def", "Main", t.upper())
    tables = spark.createDataFrame([(*place(t), "BASE TABLE") for t in shape] + [("db", "pg_catalog", "pg_class", "BASE TABLE"), ("system", "main", "x", "VIEW")], "table_catalog string, table_schema string, table_name string, table_type string")
    columns = spark.createDataFrame([(*place(t), c, "x", i) for t, cs in shape.items() for i, c in enumerate(cs)], "table_catalog string, table_schema string, table_name string, column_name string, data_type string, ordinal_position int")
    constraints = spark.createDataFrame([(f"fk_{ft}_{fc}", "Main", f"pk_{ft}_{fc}", "Main") for ft, fc, _, _ in KEYS], "constraint_name string, constraint_schema string, unique_constraint_name string, unique_constraint_schema string")
    usage_ = spark.createDataFrame([row for ft, fc, tt, tc in KEYS for row in ((f"fk_{ft}_{fc}", "Main", *place(ft), fc, 1), (f"pk_{ft}_{fc}", "Main", *place(tt), tc, 1))], "constraint_name string, constraint_schema string, table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int")
    return tables, columns, constraints, usage_


def _warehouse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables, columns, constraints, usage_ = _information(spark, sf_dir)
    views = spark.createDataFrame([("def", "Main", "V_ORDERS", "SELECT o_orderkey AS k FROM main.orders")], "table_catalog string, table_schema string, table_name string, view_definition string")
    return warehouse.graph(tables, columns, warehouse.foreign_keys(constraints, usage_), views)


_add("warehouse_foreign_keys", lambda s, d: warehouse.foreign_keys(*_information(s, d)[2:]).select("child_table", "child_column", "parent_table", "parent_column"), _COLS + "SELECT 'table:main.' || ft AS child_table, fc AS child_column, 'table:main.' || tt AS parent_table, tc AS parent_column FROM fk")
_add("warehouse_nodes", lambda s, d: _warehouse(s, d)[0].select("id", "type"), _COLS + "SELECT DISTINCT 'table:main.' || t AS id, 'TABLE' AS type FROM cols UNION ALL SELECT 'column:main.' || t || '.' || c, 'COLUMN' FROM cols")
_add("warehouse_edges", lambda s, d: _warehouse(s, d)[1].select("src", "dst", "type"), _COLS + "SELECT 'table:main.' || t AS src, 'column:main.' || t || '.' || c AS dst, 'CONTAINS' AS type FROM cols UNION SELECT 'column:main.' || ft || '.' || fc, 'column:main.' || tt || '.' || tc, 'DEPENDS_ON' FROM fk UNION SELECT 'table:main.' || ft, 'table:main.' || tt, 'DEPENDS_ON' FROM fk UNION SELECT * FROM (VALUES ('table:main.v_orders', 'table:main.orders', 'DEPENDS_ON'), ('table:main.v_orders', 'column:main.v_orders.k', 'CONTAINS'), ('column:main.v_orders.k', 'column:main.orders.o_orderkey', 'DEPENDS_ON'))")


# --- lineage events ----------------------------------------------------------------------------------------------------------------
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as runs of jobs: each type is a job that reads its user's table and writes its own."""
    rows = _read(spark, sf_dir, "events").select(F.to_json(F.struct(F.struct(F.lit("web").alias("namespace"), F.col("event_type").alias("name")).alias("job"), F.array(F.struct(F.concat(F.lit("U"), "user_id").alias("name"))).alias("inputs"), F.array(F.struct(F.concat(F.lit("out_"), "event_type").alias("name"))).alias("outputs"))).alias("j"))
    return rows.select(F.from_json("j", openlineage.SCHEMA).alias("e")).select("e.*")


_add("openlineage_edges", lambda s, d: openlineage.edges(_events(s, d)).select("src", "dst", "type"), "SELECT DISTINCT 'job:web.' || event_type AS src, 'table:u' || user_id AS dst, 'DEPENDS_ON' AS type FROM events UNION ALL SELECT DISTINCT 'job:web.' || event_type, 'table:out_' || event_type, 'WRITES_TO' FROM events UNION ALL SELECT DISTINCT 'table:out_' || event_type, 'table:u' || user_id, 'DEPENDS_ON' FROM events")
