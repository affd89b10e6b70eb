"""What a blast radius means: risk, summaries, relationships, search, exposure of personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_sensitive
from ..schema import EXPOSED, WEIGHTS
from .traverse import impact_edges, reach


def risk(affected: DataFrame, nodes: DataFrame, row_counts: DataFrame | None = None) -> DataFrame:
    """score, level of (node, depth): type weights, less with depth, more for large tables, and a bonus for wide direct impact."""
    weight = F.lit(1)
    for kind, w in WEIGHTS.items():
        weight = F.when(F.col("type") == kind, w).otherwise(weight)
    rows = affected.join(nodes.select(F.col("id").alias("node"), "type"), "node")
    if row_counts is not None:
        rows = rows.join(row_counts.select(F.col("id").alias("node"), "row_count"), "node", "left")
    else:
        rows = rows.withColumn("row_count", F.lit(None).cast("long"))
    factor = F.when(F.col("row_count") == 0, 0.5).when(F.col("row_count") >= 1_000_000, 1.5).otherwise(1.0)
    part = weight * factor * F.greatest(F.lit(0.5), 1 - 0.1 * (F.col("depth") - 1))
    total = F.coalesce(F.sum(part), F.lit(0.0)) + F.least(F.count_if(F.col("depth") == 1), F.lit(10))
    level = F.when(F.col("raw") >= 40, "CRITICAL").when(F.col("raw") >= 18, "HIGH").when(F.col("raw") >= 6, "MEDIUM").otherwise("LOW")
    return rows.agg(F.round(total, 6).alias("raw"), F.count(F.lit(1)).alias("affected")).select(F.round("raw", 1).alias("score"), level.alias("level"), "affected")


def by_type(affected: DataFrame, nodes: DataFrame) -> DataFrame:
    return affected.join(nodes.select(F.col("id").alias("node"), "type"), "node").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, columns, depends_on, dependents of each table-like node, as sorted joined names. A written table depends on its writer."""
    tables = nodes.where(F.col("type").isin("TABLE", "VIEW", "DBT_MODEL", "DBT_SOURCE", "DBT_SEED", "DBT_SNAPSHOT")).select("id")
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    columns = edges.where("type = 'CONTAINS'").join(nodes.where("type = 'COLUMN'").select(F.col("id").alias("dst"), "name"), "dst").groupBy(F.col("src").alias("id")).agg(listed("name").alias("columns"))
    needs = edges.where("type = 'DEPENDS_ON'").select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.where("type = 'WRITES_TO'").select("dst", "src"))
    up = needs.groupBy("id").agg(listed("other").alias("depends_on"))
    down = needs.groupBy(F.col("other").alias("id")).agg(listed("id").alias("dependents"))
    return tables.join(columns, "id", "left").join(up, "id", "left").join(down, "id", "left").fillna("", ["columns", "depends_on", "dependents"])


def search(nodes: DataFrame, query: str, limit: int = 20, kind: str | None = None, domain: str | None = None, owner: str | None = None, tag: str | None = None, term: str | None = None) -> DataFrame:
    """id, score by where the text is found; best first, then by id. The other arguments are facets that a hit must have.

    ``nodes`` may have ``domain``, and ``terms`` and ``tags`` as arrays; what it lacks is not searched.
    """
    q = F.lit(query.lower())
    nodes = nodes.withColumns({c: F.lit(None).cast(t) for c, t in (("domain", "string"), ("terms", "array<string>"), ("tags", "array<string>")) if c not in nodes.columns})
    own = nodes.where("type = 'COLUMN'").where(F.contains(F.lower("name"), q)).select(F.col("parent").alias("id")).distinct().withColumn("in_column", F.lit(True))
    rows = nodes.where("type <> 'COLUMN'").join(own, "id", "left")
    holds = lambda c: F.contains(F.lower(c), q)
    listed = lambda c: F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), q)), F.lit(False))
    name = F.lower("name")
    ladder = ((name == q, 100), (name.startswith(query.lower()), 80), (F.contains(name, q), 60), (holds("id"), 50), (F.col("in_column"), 40), (holds("description"), 30), (listed("terms"), 28), (listed("tags"), 26), (holds("domain"), 24), (holds("owner"), 22), (holds("path"), 20))
    score = F.lit(0)
    for found, points in reversed(ladder):
        score = F.when(found, points).otherwise(score)
    if kind:
        rows = rows.where(F.lower("type") == kind.lower())
    if domain:
        rows = rows.where(F.lower("domain") == domain.lower())
    if owner:
        rows = rows.where(F.contains(F.lower("owner"), F.lit(owner.lower())))
    if tag:
        rows = rows.where(F.exists("tags", lambda x: F.lower(x) == tag.lower()))
    if term:
        rows = rows.where(F.exists("terms", lambda x: F.contains(F.lower(x), F.lit(term.lower()))))
    rows = rows.select("id", (F.lit(1) if not query else score).cast("int").alias("score")).where("score > 0")
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def exposure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, sensitive (columns, joined), downstream, exposed, owner of each node that holds sensitive columns; the most exposed first."""
    held = nodes.where("type = 'COLUMN'").where(is_sensitive(F.col("name"))).groupBy(F.col("parent").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("sensitive"))
    below = reach(impact_edges(edges).select("from_id", "to_id"), held.select(F.col("id").alias("root"))).join(nodes.select(F.col("id").alias("node"), "type"), "node").where("type <> 'COLUMN'")
    counts = below.groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("downstream"), F.count_if(F.col("type").isin(*EXPOSED)).alias("exposed"))
    owners = nodes.select("id", "owner")
    return held.join(counts, "id", "left").join(owners, "id", "left").fillna(0, ["downstream", "exposed"]).orderBy(F.desc("exposed"), F.desc("downstream"), "id")


def exposure_totals(exposure_: DataFrame) -> DataFrame:
    """assets, columns, exposed_assets, unowned: one row over an exposure report."""
    return exposure_.agg(F.count(F.lit(1)).alias("assets"), F.coalesce(F.sum(F.size(F.split("sensitive", ","))), F.lit(0)).alias("columns"), F.count_if(F.col("exposed") > 0).alias("exposed_assets"), F.count_if(F.coalesce("owner", F.lit("")) == "").alias("unowned"))


def column_relationships(nodes: DataFrame, edges: DataFrame, text: str | None = None) -> DataFrame:
    """from_table, from_column, to_table, to_column, via of columns that depend on columns; those that mention ``text``, if given."""
    names = nodes.where("type = 'COLUMN'").select("id", "name", "parent")
    rows = edges.where("type = 'DEPENDS_ON'").join(names.select(F.col("id").alias("src"), F.col("parent").alias("from_table"), F.col("name").alias("from_column")), "src")
    rows = rows.join(names.select(F.col("id").alias("dst"), F.col("parent").alias("to_table"), F.col("name").alias("to_column")), "dst")
    if text:
        q = F.lit(text.lower())
        rows = rows.where(F.contains(F.lower("src"), q) | F.contains(F.lower("dst"), q))
    return rows.select("from_table", "from_column", "to_table", "to_column", "via")
