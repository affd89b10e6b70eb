"""Traversal by level-synchronous joins. State is (root, node, depth), so all roots go at once; a level is a join and an anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..schema import FORWARD
from .storage import forget, settle


def impact_edges(edges: DataFrame, include_inferred: bool = True) -> DataFrame:
    """from_id, to_id, type, provenance, via: which node a change of which reaches."""
    used = edges if include_inferred else edges.where("provenance = 'extracted'")
    forward = F.col("type").isin(*FORWARD)
    return used.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("from_id"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("to_id"), "type", "provenance", "via")


def _spread(links: DataFrame, start: DataFrame, level: int, never: DataFrame, max_depth: int | None, rooted: DataFrame | None = None) -> DataFrame:
    """All (root, node, depth) got from the rows of ``start`` at ``level`` on. Rows of ``start`` below it are known, and lead nowhere.

    ``links``: from_id, to_id, open to all roots; ``rooted``: those open to one root. Nodes in ``never`` (node) aren't entered. One
    grouped union and one write a level, which also counts what is new.
    """
    links = settle(links.select(F.col("from_id").alias("node"), "to_id").distinct())
    rooted = settle(rooted.select("root", F.col("from_id").alias("node"), "to_id").distinct()) if rooted is not None else None
    known = settle(start.select("root", "node", F.col("depth").cast("int").alias("depth")))
    while max_depth is None or level < max_depth:
        frontier = known.where(F.col("depth") == level).select("root", "node")
        step = frontier.join(links, "node").select("root", F.col("to_id").alias("node"))
        if rooted is not None:
            step = step.union(frontier.join(rooted, ["root", "node"]).select("root", F.col("to_id").alias("node")))
        step = step.join(never, "node", "left_anti").select("root", "node", F.lit(level + 1).alias("depth"))
        seen = Observation()
        grown = known.union(step).groupBy("root", "node").agg(F.min("depth").alias("depth"))
        grown = settle(grown.observe(seen, F.count_if(F.col("depth") == level + 1).alias("fresh")))
        forget(known)
        known, level = grown, level + 1
        if not seen.get["fresh"]:
            break
    forget(links, *([rooted] if rooted is not None else []))
    return known


def _nothing(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], "node string")


def reach(links: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node, depth of all that can be reached from each root (root itself excluded). ``links``: from_id, to_id."""
    start = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    return _spread(links, start, 0, _nothing(roots), max_depth).where("depth > 0")


def upstream(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, include_inferred: bool = True) -> DataFrame:
    return reach(turned(impact_edges(edges, include_inferred)), roots, max_depth)


def turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))


def lineage(nodes: DataFrame, edges: DataFrame, roots: DataFrame, up: int | None = None, down: int | None = None, include_inferred: bool = True) -> DataFrame:
    """direction, root, node, depth: what is above and below each root."""
    above = upstream(edges, roots, up, include_inferred).select(F.lit("up").alias("direction"), "root", "node", "depth")
    return above.union(blast_radius(nodes, edges, roots, down, include_inferred, together=False).select(F.lit("down"), "root", "node", "depth"))


def tree(edges: DataFrame, root: str, direction: str = "down", max_depth: int | None = None, include_inferred: bool = True) -> DataFrame:
    """node, depth, parent, via, provenance: each node once, under the least of its parents a level nearer to the root.

    The reference's depth-first order can hang a node deeper; here it is always at its shortest distance.
    """
    links = impact_edges(edges, include_inferred)
    if direction == "up":
        links = links.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "type", "provenance", "via")
    found = reach(links.select("from_id", "to_id"), edges.sparkSession.createDataFrame([(root,)], "root string"), max_depth).select("node", "depth")
    above = found.union(edges.sparkSession.createDataFrame([(root, 0)], "node string, depth int")).select(F.col("node").alias("from_id"), (F.col("depth") + 1).alias("depth"))
    steps = links.join(above, "from_id").join(found.select(F.col("node").alias("to_id"), "depth"), ["to_id", "depth"])
    first = F.min(F.struct("from_id", "type", "provenance", "via"))
    return steps.groupBy(F.col("to_id").alias("node"), "depth").agg(first.alias("f")).select("node", "depth", F.col("f.from_id").alias("parent"), F.coalesce("f.via", F.lower("f.type")).alias("via"), "f.provenance")


def column_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, parent of each column: the declared parent if it is a node, else the first that contains it."""
    columns = nodes.where("type = 'COLUMN'").select("id", "parent")
    declared = columns.join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", F.col("parent").alias("declared"))
    holder = edges.where("type = 'CONTAINS'").groupBy(F.col("dst").alias("id")).agg(F.min_by("src", "seq").alias("holder"))
    return columns.select("id").join(declared, "id", "left").join(holder, "id", "left").select("id", F.coalesce("declared", "holder").alias("parent")).where("parent is not null")


def blast_radius(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int | None = None, include_inferred: bool = True, together: bool = True) -> DataFrame:
    """root, node, depth of what a change of each root reaches.

    A column also reaches its table (depth 1) and what that reaches, where of columns only those of its own name
    count. ``together``: the roots are one change, and none of them is ever in the result.
    """
    links = impact_edges(edges, include_inferred)
    roots = roots.select("root").distinct().join(nodes.select(F.col("id").alias("root")), "root", "left_semi")
    start = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    never = roots.select(F.col("root").alias("node")) if together else _nothing(roots)
    first = _spread(links, start, 0, never, max_depth).where("depth > 0")
    columns = roots.join(nodes.select(F.col("id").alias("root"), "type", F.lower("name").alias("own")), "root").where("type = 'COLUMN'")
    parents = columns.join(column_parents(nodes, edges).withColumnRenamed("id", "root"), "root").select("root", "own", "parent")
    if max_depth == 0 or parents.isEmpty():
        return first
    # the second phase starts at the parent, seen or not; what the first one found keeps its depth
    at_parent = parents.select("root", F.col("parent").alias("node"), F.lit(1).alias("depth"))
    seen = first.select("root", "node", F.lit(-1).alias("depth")).union(start.select("root", "node", F.lit(-1))).join(at_parent, ["root", "node"], "left_anti")
    named = links.join(nodes.select(F.col("id").alias("to_id"), F.col("type").alias("kind"), F.lower("name").alias("name")), "to_id", "left")
    into_column = F.coalesce((F.col("type") == "CONTAINS") & (F.col("kind") == "COLUMN"), F.lit(False))
    own = named.where(into_column).join(parents.select("root", F.col("own").alias("name")), "name").select("root", "from_id", "to_id")
    second = _spread(named.where(~into_column), at_parent.union(seen), 1, never, max_depth, own).where("depth > 0")
    added = second.join(first, ["root", "node"], "left_anti")
    added = added.join(never, "node", "left_anti") if together else added
    return first.union(added.where("root <> node").select(*first.columns))


#: Roots whose reach is worked out together: bounds the (root, node) rows of a traversal by so many times the nodes.
BLOCK = 4096


def _by_blocks(links: DataFrame, roots: DataFrame, measure) -> DataFrame:
    """``measure`` of the reach of all roots, a block of roots at a time."""
    roots = settle(roots)
    blocks = roots.count() // BLOCK + 1
    out = None
    for b in range(blocks):
        part = settle(measure(reach(links, roots.where(F.pmod(F.xxhash64("root"), F.lit(blocks)) == b))))
        out = part if out is None else out.union(part)
    forget(roots)
    return out


def hotspots(nodes: DataFrame, edges: DataFrame, top: int = 10, include_inferred: bool = True) -> DataFrame:
    """id, blast, degree of the ``top`` nodes other than columns."""
    wanted = nodes.where("type <> 'COLUMN'").select("id")
    links = impact_edges(edges, include_inferred).select("from_id", "to_id")
    blast = _by_blocks(links, wanted.withColumnRenamed("id", "root"), lambda r: r.groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("blast")))
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    out = wanted.join(blast, "id", "left").join(degree, "id", "left").fillna(0, ["blast", "degree"])
    return out.orderBy(F.desc("blast"), F.desc("degree"), "id").limit(top)


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, layer: how deep its deepest upstream node is."""
    ids = nodes.select("id")
    links = turned(impact_edges(edges))
    deep = _by_blocks(links, ids.withColumnRenamed("id", "root"), lambda r: r.groupBy(F.col("root").alias("id")).agg(F.max("depth").alias("layer")))
    return ids.join(deep, "id", "left").fillna(0, ["layer"])


def ends(nodes: DataFrame, edges: DataFrame, which: str) -> DataFrame:
    """id of the roots (nothing upstream) or leaves (nothing downstream)."""
    column = {"roots": "to_id", "leaves": "from_id"}[which]
    return nodes.select("id").join(impact_edges(edges).select(F.col(column).alias("id")), "id", "left_anti")


def paths(edges: DataFrame, source: str, target: str, cutoff: int = 25) -> DataFrame:
    """path, length of all simple paths of at most ``cutoff`` edges; grown only through nodes that lead to the target."""
    spark = edges.sparkSession
    links = impact_edges(edges).select("from_id", "to_id").where("from_id <> to_id").distinct()
    back = reach(links.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), spark.createDataFrame([(target,)], "root string"), cutoff)
    useful = back.select(F.col("node").alias("to_id")).union(spark.createDataFrame([(target,)], "to_id string"))
    links = settle(links.join(useful, "to_id", "left_semi"))
    live = spark.createDataFrame([([source], source)], "path array<string>, at string")
    done = live.where("false")
    for _ in range(cutoff):
        live = live.join(links, F.col("at") == F.col("from_id")).where(~F.array_contains("path", F.col("to_id"))).select(F.array_append("path", F.col("to_id")).alias("path"), F.col("to_id").alias("at"))
        live = settle(live)
        done = done.union(live.where(F.col("at") == target))
        live = live.where(F.col("at") != target)
        if live.isEmpty():
            break
    return done.select(F.array_join("path", " > ").alias("path"), (F.size("path") - 1).cast("long").alias("length"))
