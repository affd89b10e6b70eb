"""Governance: glossary terms, domains, deprecations and owners that a document attaches to assets.

An attachment is a row (kind, ref, value, owner, detail, replacement, seq); refs are ids, wildcards over ids, or names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sanitize
from . import store, traverse

ATTACHMENT = "kind string, ref string, value string, owner string, detail string, replacement string, seq long"


def attachments(spark: SparkSession, document: dict) -> DataFrame:
    """The rows of a governance document; texts are cleaned and cut (names to 120 characters, definitions to 1,000, reasons to 500)."""
    rows = []

    def add(kind, refs, value, owner=None, detail=None, replacement=None):
        rows.extend((kind, str(r), value, owner, detail, replacement) for r in refs)

    for e in document.get("glossary") or []:
        add("term", e.get("applies_to") or e.get("assets") or [""], e.get("term") or e.get("name"), e.get("owner"), e.get("definition") or e.get("description") or "")
    for e in document.get("domains") or document.get("data_products") or []:
        add("domain", e.get("assets") or e.get("applies_to") or [], e.get("name"), e.get("owner"))
    for e in document.get("deprecations") or []:
        add("deprecated", [e.get("asset") or e.get("name") or ""], e.get("since"), None, e.get("reason") or "", e.get("replacement"))
    for ref, owner in (document.get("owners") or {}).items():
        add("owner", [ref], owner)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ATTACHMENT)
    named = F.when(F.col("kind").isin("term", "domain"), F.trim(sanitize(F.col("value"), 120))).otherwise(F.col("value"))
    detail = F.when(F.col("kind") == "term", sanitize(F.col("detail"), 1000)).when(F.col("kind") == "deprecated", sanitize(F.col("detail"), 500))
    return df.withColumns({"value": named, "detail": detail}).where(~F.col("kind").isin("term", "domain") | (F.coalesce("value", F.lit("")) != ""))


def attached(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The attachments with the id of each asset that their ref stands for (several for a wildcard); refs that mean nothing are left out."""
    refs = rows.where("ref <> ''").select("ref").distinct()
    hits = store.matching(nodes, refs.select(F.col("ref").alias("pattern"))).select(F.col("pattern").alias("ref"), "id")
    names = store.resolve(nodes, refs.join(hits.select("ref").distinct(), "ref", "left_anti").where(~F.col("ref").rlike(r"[*?\[]"))).where("id is not null")
    return rows.join(hits.union(names.select("ref", "id")), "ref")


def unmatched(rows: DataFrame, attached_: DataFrame, shown: int = 20) -> DataFrame:
    """kind, value, ref of the first attachments that match nothing."""
    return rows.where("ref <> '' or kind = 'deprecated'").join(attached_.select("seq").distinct(), "seq", "left_anti").orderBy("seq").limit(shown).select("kind", "value", "ref")


def governed(nodes: DataFrame, attached_: DataFrame) -> DataFrame:
    """``nodes`` with owner, domain and terms as attached: the last domain and owner of the document win, a domain's owner only where there is none."""
    own = attached_.groupBy("id").agg(
        F.max_by("value", F.when(F.col("kind") == "owner", F.col("seq"))).alias("_owner"), F.min_by("owner", F.when((F.col("kind") == "domain") & F.col("owner").isNotNull(), F.col("seq"))).alias("_domain_owner"),
        F.max_by("value", F.when(F.col("kind") == "domain", F.col("seq"))).alias("domain"), F.sort_array(F.collect_set(F.when(F.col("kind") == "term", F.col("value")))).alias("terms"),
    )
    out = nodes.join(own, "id", "left")
    return out.withColumn("owner", F.coalesce("_owner", "owner", "_domain_owner")).drop("_owner", "_domain_owner")


def glossary(rows: DataFrame, attached_: DataFrame) -> DataFrame:
    """term, definition, owner, assets (sorted) of every term, used or not."""
    said = rows.where("kind = 'term'").groupBy(F.col("value").alias("term")).agg(F.max_by("detail", "seq").alias("definition"), F.max_by("owner", "seq").alias("owner"))
    used = attached_.where("kind = 'term'").groupBy(F.col("value").alias("term")).agg(F.sort_array(F.collect_set("id")).alias("assets"))
    return said.join(used, "term", "left").withColumn("assets", F.coalesce("assets", F.array().cast("array<string>")))


def domains(governed_: DataFrame) -> DataFrame:
    """domain, assets (sorted)."""
    return governed_.where("domain is not null").groupBy("domain").agg(F.sort_array(F.collect_set("id")).alias("assets"))


def deprecated(attached_: DataFrame) -> DataFrame:
    """id, reason, replacement, since: the document's last word on each."""
    last = F.max_by(F.struct(F.col("detail").alias("reason"), "replacement", F.col("value").alias("since")), "seq")
    return attached_.where("kind = 'deprecated'").groupBy("id").agg(last.alias("d")).select("id", "d.reason", "d.replacement", "d.since")


def still_used(deprecated_: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, users: how many nodes other than columns a deprecated asset still reaches; most first."""
    reached = traverse.blast_radius(nodes, edges, deprecated_.select(F.col("id").alias("root")), together=False)
    users = reached.where("node not like 'column:%'").groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("users"))
    return deprecated_.select("id").join(users, "id", "left").fillna(0, ["users"]).orderBy(F.desc("users"), "id")
