"""Graphs of a DataHub server's datasets, fetched page by page through a transport that can be replaced."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = "struct<urn:string,path:string>"
ENTITY = (
    "struct<urn:string,name:string,platform:struct<name:string>,ownership:struct<owners:array<struct<owner:struct<username:string,name:string>>>>,"
    "schemaMetadata:struct<fields:array<struct<fieldPath:string,nativeDataType:string,type:string>>>,upstream:struct<relationships:array<struct<entity:struct<urn:string,name:string>>>>,"
    f"fineGrainedLineages:array<struct<upstreams:array<{_PLACE}>,downstreams:array<{_PLACE}>>>>"
)
QUERY = (
    "query datasets($query: String!, $start: Int!, $count: Int!) { search(input: {type: DATASET, query: $query, start: $start, count: $count}) { total searchResults { entity { urn ... on Dataset { name platform { name } "
    "ownership { owners { owner { ... on CorpUser { username } ... on CorpGroup { name } } } } schemaMetadata { fields { fieldPath nativeDataType type } } "
    "upstream: relationships(input: {types: [\"DownstreamOf\", \"Produces\"], direction: OUTGOING, count: 100}) { relationships { entity { urn ... on Dataset { name } } } } "
    "fineGrainedLineages { upstreams { urn path } downstreams { urn path } } } } } } }"
)

Transport = Callable[[str, dict], dict]


def http(server: str, token: str | None = None) -> Transport:
    def send(query: str, variables: dict) -> dict:
        request = urllib.request.Request(f"{server.rstrip('/')}/api/graphql", json.dumps({"query": query, "variables": variables}).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
        with urllib.request.urlopen(request, timeout=60) as answer:
            return json.load(answer)

    return send


def pages(send: Transport, query: str = "*", page: int = 100, most: int = 2000) -> Iterator[dict]:
    """Entities, a page at a time, until the server has no more or ``most`` are asked for (the importer's own limit)."""
    start = 0
    while start < most:
        answer = send(QUERY, {"query": query, "start": start, "count": page})
        if answer.get("errors") and not answer.get("data"):
            raise RuntimeError(f"the catalog refused the query: {answer['errors']}")
        found = (answer.get("data") or {}).get("search") or {}
        results = found.get("searchResults") or []
        yield from (r["entity"] for r in results if r.get("entity"))
        start += len(results)
        if not results or start >= int(found.get("total") or 0):
            return


def entities(spark: SparkSession, found: Iterator[dict]) -> DataFrame:
    """One row an entity, by schema."""
    rows = [(json.dumps(e),) for e in found]
    return spark.createDataFrame(rows, "j string").select(F.from_json("j", ENTITY).alias("e")).where("e.urn is not null").select("e.*")


def dataset_name(urn: Column) -> Column:
    """The name in a dataset's URN."""
    return F.regexp_extract(urn, r"^urn:li:dataset:\(urn:li:dataPlatform:[^,]+,(.+),[^,]+\)$", 1)


def job_name(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^urn:li:dataJob:\(.*,([^,]+)\)$", 1)


def _table(urn: Column, name: Column | None = None) -> Column:
    known = F.nullif(dataset_name(urn), F.lit(""))
    return F.concat(F.lit("table:"), F.lower(F.coalesce(known, name, urn) if name is not None else F.coalesce(known, urn)))


def graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of entities(): datasets with owners and columns, what they come from, column by column where it is known."""
    none, c = F.lit(None).cast("string"), F.col
    own = rows.withColumn("id", _table(c("urn"), c("name")))
    owner = F.get(F.filter(F.transform("ownership.owners", lambda o: F.coalesce(o["owner"]["username"], o["owner"]["name"])), lambda o: o.isNotNull()), 0)
    columns = own.select("id", F.explode("schemaMetadata.fields").alias("f")).select("id", F.lower("f.fieldPath").alias("name"), F.coalesce("f.nativeDataType", "f.type").alias("kind")).where("name is not null")
    ups = own.select("id", F.explode("upstream.relationships").alias("r")).select("id", c("r.entity.urn").alias("up"), c("r.entity.name").alias("up_name"))
    tables = ups.where("up like 'urn:li:dataset:%'").withColumn("other", _table(c("up"), c("up_name")))
    jobs = ups.where("up like 'urn:li:dataJob:%'").withColumn("other", F.concat(F.lit("job:"), job_name(c("up"))))
    fine = own.select("id", "urn", F.explode("fineGrainedLineages").alias("g")).select("id", "urn", F.explode("g.downstreams").alias("d"), c("g.upstreams").alias("us")).select("id", "urn", "d", F.explode("us").alias("u"))
    down = F.when(c("d.urn").isNull() | (c("d.urn") == c("urn")), c("id")).otherwise(_table(c("d.urn")))
    bare = lambda x: F.regexp_replace(x, "^[^:]*:", "")
    column = lambda table, name: F.concat(F.lit("column:"), bare(table), F.lit("."), F.lower(name))
    fine = fine.where("d.path is not null and u.path is not null and u.urn is not null").select(column(down, c("d.path")).alias("src"), column(_table(c("u.urn")), c("u.path")).alias("dst"))
    node = lambda df, id_, kind, name, parent=none, data_type=none, owner_=none: df.select(id_.alias("id"), F.lit(kind).alias("type"), name.alias("name"), parent.alias("parent"), data_type.alias("data_type"), owner_.alias("owner"))
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit("extracted").alias("provenance"), F.lit("datahub").alias("via"))
    held = column(c("id"), c("name"))
    nodes = node(own, c("id"), "TABLE", bare(c("id")), owner_=owner).union(node(columns, held, "COLUMN", c("name"), c("id"), c("kind"))).union(node(tables, c("other"), "TABLE", bare(c("other")))).union(node(jobs, c("other"), "DAG", bare(c("other"))))
    edges = edge(columns, c("id"), held, "CONTAINS").union(edge(tables, c("id"), c("other"), "DEPENDS_ON")).union(edge(jobs, c("other"), c("id"), "WRITES_TO")).union(edge(fine, c("src"), c("dst"), "DEPENDS_ON"))
    return nodes.distinct(), edges.distinct()
