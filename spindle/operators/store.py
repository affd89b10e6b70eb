"""Graph storage: upserts, merge, drift, aliases, lookups. Order matters only through ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PREFIXES

_LATEST = ("parent", "data_type", "primary_key", "owner", "description")


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """First type and name, last non-null attributes, first non-null path of each id. One shuffle, partially aggregated."""
    first = [F.min_by(c, "seq").alias(c) for c in ("type", "name")]
    path = F.min_by("path", F.when(F.col("path").isNotNull(), F.col("seq"))).alias("path")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in _LATEST]
    return nodes.groupBy("id").agg(*first, path, *last, F.min("seq").alias("seq"))


def upsert_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (src, dst, type); an inferred one becomes extracted if any later one is."""
    first = F.min_by("provenance", "seq")
    upgraded = F.when((first == "inferred") & F.bool_or(F.col("provenance") == "extracted"), "extracted").otherwise(first)
    return edges.groupBy("src", "dst", "type").agg(upgraded.alias("provenance"), F.min_by("via", "seq").alias("via"), F.min("seq").alias("seq"))


def merge(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Graph b into graph a; b's rows come after a's."""
    out = []
    for x, y, upsert in zip(a, b, (upsert_nodes, upsert_edges)):
        after = x.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("_after"))
        moved = y.crossJoin(F.broadcast(after)).withColumn("seq", F.col("seq") + F.col("_after")).drop("_after")  # one row
        out.append(upsert(x.unionByName(moved)))
    return out[0], out[1]


def inferred_type(id_: Column) -> Column:
    out = F.lit("TABLE")
    for prefix, kind in PREFIXES.items():
        out = F.when(F.substring_index(id_, ":", 1) == prefix, kind).otherwise(out)
    return out


def with_missing_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, and one for each edge end that has none, of the type that its id tells."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct().join(nodes, "id", "left_anti")
    name = F.regexp_replace(F.regexp_replace("id", "^[^:]*:", ""), "^.*::", "")
    return nodes.unionByName(ends.select("id", inferred_type(F.col("id")).alias("type"), name.alias("name")), allowMissingColumns=True)


def drift(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """kind, change, key of nodes and edges that came or went."""
    key = ["src", "dst", "type"]
    shown = F.concat_ws(" ", *key)

    def only(a, b, change):
        n = a[0].join(b[0], "id", "left_anti").select(F.when(F.col("type") == "COLUMN", "column").otherwise("node").alias("kind"), F.lit(change).alias("change"), F.col("id").alias("key"))
        return n.union(a[1].join(b[1], key, "left_anti").select(F.lit("edge"), F.lit(change), shown))

    return only(new, old, "added").union(only(old, new, "removed"))


def alias_links(nodes: DataFrame) -> DataFrame:
    """(short, long): a table whose bare name is a dot-suffix of exactly one longer name. Suffixes are exploded, so it is an equi-join."""
    tables = nodes.where(F.col("type").isin("TABLE", "VIEW")).select("id", F.regexp_replace("id", "^[^:]*:", "").alias("bare"))
    parts = F.split("bare", "[.]")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    longer = tables.where(F.instr("bare", ".") > 0).select(F.col("id").alias("long"), F.explode(suffixes).alias("bare"))
    found = tables.select(F.col("id").alias("short"), "bare").join(longer, "bare")
    return found.groupBy("short").agg(F.count(F.lit(1)).alias("n"), F.min("long").alias("long")).where("n = 1").select("short", "long")


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    inside = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes.join(ids, "id", "left_semi"), inside


def find(nodes: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over id, name and path."""
    q = text.lower()
    return nodes.where(F.contains(F.lower("id"), F.lit(q)) | F.contains(F.lower("name"), F.lit(q)) | F.coalesce(F.contains(F.lower("path"), F.lit(q)), F.lit(False)))


def lookup(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """The nodes of these ids."""
    return nodes.where(F.col("id").isin(ids))


def of_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("type") == kind)


def incident(edges: DataFrame, id_: str) -> DataFrame:
    """Edges out of a node, then those into it; a loop is in both."""
    return edges.where(F.col("src") == id_).withColumn("side", F.lit("out")).union(edges.where(F.col("dst") == id_).withColumn("side", F.lit("in")))


def matching(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, id of the ids that each pattern stands for: an id, or one with ``*``, ``?`` and ``[...]``, in its own case.

    Patterns are those of one document; their ids are equi-joined, and only wildcards scan the nodes, all in one pass.
    """
    wild = F.col("pattern").rlike(r"[*?\[]")
    exact = patterns.where(~wild).join(nodes.select(F.col("id").alias("pattern")), "pattern", "left_semi").select("pattern", F.col("pattern").alias("id"))
    globs = [r[0] for r in patterns.where(wild).select("pattern").distinct().collect()]
    if not globs:
        return exact
    hits = F.array(*[F.when(F.col("id").rlike(_regex(g)), F.lit(g)) for g in globs])
    return exact.union(nodes.select(F.explode(F.array_compact(hits)).alias("pattern"), "id"))


def _regex(glob: str) -> str:
    """A wildcard as an anchored pattern."""
    out, i = "", 0
    while i < len(glob):
        c, end = glob[i], glob.find("]", i + 2)
        if c == "[" and end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]"
            i = end + 1
            continue
        out += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() else "\\" + c)
        i += 1
    return f"(?s)^{out}$"


def resolve(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """ref, id: exact id, else the one exact name, else path, else file path, else substring; null if none is unique."""
    names = [r[0] for r in refs.select("ref").distinct().collect()]  # the refs of one request: a literal in one scan of the nodes
    if not names:
        return refs.select("ref", F.lit(None).cast("string").alias("id"))
    held = lambda column, r: F.coalesce(F.contains(F.lower(column), F.lower(r)), F.lit(False))
    same = lambda column, r: F.coalesce(F.col(column) == r, F.lit(False))
    inside = lambda r: held("id", r) | held("name", r) | held("path", r)
    ranks = lambda r: F.array_compact(F.array(F.when(same("id", r), 0), F.when(same("name", r), 1), F.when(same("path", r), 2), F.when(same("path", r) & (F.col("type") == "FILE"), 3), F.when(inside(r), 4)))
    asked = F.transform(F.array(*map(F.lit, names)), lambda r: F.struct(r.alias("ref"), ranks(r).alias("ranks")))
    hits = nodes.select("id", F.inline(F.filter(asked, lambda x: F.size(x["ranks"]) > 0))).select("ref", "id", F.explode("ranks").alias("rank"))
    each = hits.groupBy("ref", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    return refs.join(each.groupBy("ref").agg(F.min_by("id", "rank").alias("id")), "ref", "left")
