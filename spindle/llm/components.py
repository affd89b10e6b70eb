"""Groups of rows that near-duplicate links connect, without listing all pairs of a bucket.

``linked_groups`` takes (key, id) memberships from a banding scheme and a function that
confirms pairs. Pairs go through each bucket's hub first, the id that meets most others: that joins
nearly all of a large group at a cost linear in its size. What stays apart in a bucket afterwards is
compared in full, so no link that the banding can see is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, let_go, materialise, together

#: Parts that the keys are gone through in, where columns are carried and what is still apart is compared in full.
SLICES = 4

def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 16)), F.bit_xor(h)).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until the
    edges are stars. No neighbour list is ever collected, so a hub of any degree is streamed.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        if not now[0]:
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges, last = materialise(small.where("u <> v").distinct(), "edges"), edges
        discard(last)
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = out.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
    out._spindle_path = edges._spindle_path
    return out


def linked_groups(members: DataFrame, confirm: Callable[[DataFrame], DataFrame], bound: Callable[[DataFrame], DataFrame] | None = None, possible: str | None = None, apart: str | None = None, candidates: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``members``: distinct (key, id), keys with at least two ids. ``confirm``: (a, b) pairs to the linked ones among them.

    ``bound`` gives further columns of ids (a row each), and ``possible`` is SQL over those columns of two ids, as x.* and y.*, that
    holds for every linked pair: it keeps pairs that can't be linked from being made at all. Further columns c of ``members`` are in x.* and
    y.* too; ``apart`` is SQL over c and hub_c whose least value comes with each pair through a hub, as column apart, to ``candidates``,
    which writes those (a, b) that are to be confirmed. A column n of ``members``, if it is there, has the number of ids of the key.
    Returns (id, component) of the ids that have a link, and the confirmed links (a, b).
    """
    # the id that meets most others: copies of one text are all like it, but often not like one another
    carried = [c for c in members.columns if c not in ("key", "id", "n")]
    own = F.struct(F.col("id").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in carried]) if carried else F.col("id")
    most = F.max_by(own, F.struct("met", "id"))
    if "n" in members.columns:
        # keys of up to three ids need no hub: all their pairs are made, in one exchange
        large = members.where("n > 3")
        spread = materialise(large.withColumn("met", F.sum("n").over(Window.partitionBy("id"))).groupBy("key").agg(most.alias("hub")), "spread")
        through = _through(large, spread, carried)
        through = through.unionByName(_all_pairs(members.where("n <= 3"), carried).select(through.columns))
        large = large.drop("n")
    else:
        spread, through = _spread(members, own, most, carried)
        large = members.join(spread.where("n > 3").select("key"), "key", "left_semi")
    tested = materialise(_pairs(through, apart), "pairs")
    del through
    let_go(members.sparkSession)
    if candidates:
        tested, all_ = candidates(tested), tested
        discard(all_)
    found = confirm(tested)
    links = materialise(found, "links")
    discard(found)
    # of a bucket of up to three every pair was made
    large = materialise(large, "members")
    discard(members, spread)
    members = large
    let_go(members.sparkSession)
    groups = connected_components(links)
    let_go(members.sparkSession)
    rest = materialise(_rest(members, groups, carried), "rest")
    let_go(members.sparkSession)
    known = materialise(bound(rest.select("id").distinct()) if bound else rest.select("id").distinct(), "bounds")
    let_go(members.sparkSession)
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
    apart = apart & F.expr(possible) if possible else apart
    slices, parts = SLICES if carried else 1, []
    for k in range(slices):  # keys meet within a slice, so that an exchange holds a slice of the rows with their bounds
        own = rest.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == k) if slices > 1 else rest
        x = own.select("key", "id", "component", *carried).join(known, "id").alias("x")
        y = own.where("minor").select("key", F.col("id").alias("hub"), "component", *carried).join(known.withColumnRenamed("id", "hub"), "hub").alias("y")
        parts.append(_pairs(x.join(y, apart).select("x.id", "y.hub")))
        if slices > 1:
            parts[-1] = materialise(parts[-1], "pairs")
            del own, x, y
            let_go(members.sparkSession)
    made = together(parts).distinct() if slices > 1 else parts[0]
    more = materialise(made.join(tested, ["a", "b"], "left_anti"), "pairs")
    discard(*parts)
    discard(rest, known, members, tested)
    let_go(members.sparkSession)
    found = confirm(more)
    links_, groups_ = links, groups
    links = materialise(links.union(found), "links")
    discard(found, links_, groups_, more)
    return connected_components(links), links


def _spread(members: DataFrame, own: Column, most: Column, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """The hubs of each key, and the members of keys beside them; two hubs at least of a key of up to three: that is every pair of it."""
    met = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").groupBy("id").agg(F.sum("n").alias("met"))
    spread = materialise(members.join(met, "id").groupBy("key").agg(most.alias("hub"), F.min(own).alias("low"), F.max(own).alias("high"), F.count(F.lit(1)).alias("n")), "spread")
    let_go(members.sparkSession)
    hubs = spread.select("key", F.explode(F.array_distinct(F.when(F.col("n") > 3, F.array("hub")).otherwise(F.array("hub", "low", "high")))).alias("hub"))
    return spread, _through(members, hubs, carried)


def _through(members: DataFrame, hubs: DataFrame, carried: list[str]) -> DataFrame:
    return members.join(hubs.select("key", "hub.*") if carried else hubs, "key").where("id <> hub").drop("n")


def _all_pairs(members: DataFrame, carried: list[str]) -> DataFrame:
    """key, id, hub and what is carried of both, of every pair of ids of each key; for keys of two or three ids."""
    ids = members.repartition("key").groupBy("key").agg(F.collect_list(F.struct("id", *carried)).alias("ids"))
    pair = lambda i, j: F.struct(F.get("ids", F.lit(i)).alias("x"), F.get("ids", F.lit(j)).alias("y"))
    each = F.when(F.size("ids") == 2, F.array(pair(0, 1))).otherwise(F.array(pair(0, 1), pair(0, 2), pair(1, 2)))
    return ids.select("key", F.explode(each).alias("p")).select("key", "p.x.*", F.col("p.y.id").alias("hub"), *[F.col(f"p.y.{c}").alias(f"hub_{c}") for c in carried])


def _pairs(joined: DataFrame, apart: str | None = None) -> DataFrame:
    pair = F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")
    joined = joined.where("id <> hub")
    return joined.groupBy(*pair).agg(F.min(F.expr(apart)).alias("apart")) if apart else joined.select(*pair).distinct()


def _rest(members: DataFrame, groups: DataFrame, carried: list[str]) -> DataFrame:
    """(key, id, component, minor, those carried) of the keys that still hold several components; minor: not of the key's largest."""
    labelled = members.join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"), *carried)
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    return labelled.join(main.select("key", "main"), "key").select("key", "id", "component", (F.col("component") != F.col("main")).alias("minor"), *carried)
