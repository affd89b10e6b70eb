"""Document fingerprints from closed syncmers.

A text is read as tokens (pieces of at most ``PIECE`` characters between white space, so that texts without spaces have
tokens too). A run of ``K`` tokens is an anchor if the least hash among its runs of ``S`` lies at its first or last
place: a choice that depends on the run alone, so equal passages have equal anchors wherever they stand.
The fingerprint is the ``SIZE`` least distinct anchor hashes of the whole text; likeness is the share
of the two fingerprints' common bottom values that both have: an estimate of the anchors' Jaccard similarity j, with a
standard error of sqrt(j (1 - j) / 96), 0.051 at most; it is exact for texts of up to 48 anchors each.

Only DataFrame expressions. To meet the next document, rows are range-sorted by id alone; each text then moves once, by an
exchange that both joins read, and its prefix and fingerprint go to the one document that asks for them.

Null texts are empty; an empty text has the empty fingerprint, and two empty ones are alike (1.0). Texts too short for an anchor
have one that covers all of them. Documents go by descending doc_id, null ids last, and by a hash of the text where an
id repeats; rows that are wholly equal are one document there, and each of them comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_width

K, S, PIECE, SIZE = 5, 2, 16, 96


def _with_anchors(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the anchors of ``text`` in order, as (position, hash)."""
    h, s = f"{name}_h", f"{name}_s"
    tokens = F.regexp_extract_all(text, F.lit(rf"([^\x20\x09-\x0D]{{1,{PIECE}}})"), F.lit(1))
    rows = rows.withColumn(h, F.transform(tokens, lambda t: F.xxhash64(t)))
    rows = rows.withColumn(s, F.zip_with(h, F.slice(h, S, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    inner = K - S  # the last place of a run's inner runs

    def anchor(x: Column, i: Column) -> Column:
        at_edge = F.least(x, F.get(s, i + inner)) <= F.least(*[F.get(s, i + j) for j in range(1, inner)])
        run = F.xxhash64(x, F.get(s, i + 2), F.get(h, i + K - 1))
        return F.when(F.get(h, i + K - 1).isNotNull() & at_edge, F.struct(i.alias("position"), run.alias("hash")))

    found = F.array_compact(F.transform(s, anchor))
    whole = F.array(F.struct(F.lit(0).alias("position"), F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)).alias("hash")))
    rows = rows.withColumn(name, found)
    return rows.withColumn(name, F.when((F.size(name) == 0) & (F.size(h) > 0), whole).otherwise(F.col(name))).drop(h, s)


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, position, hash of every anchor of every text, for positional matching by a join on hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return _with_anchors(rows, "text", "a").select("doc_id", F.inline("a"))


def _with_sketch(rows: DataFrame, text: str, name: str) -> DataFrame:
    rows = _with_anchors(rows, text, f"{name}_a")
    least = F.slice(F.sort_array(F.array_distinct(F.transform(f"{name}_a", lambda x: x["hash"]))), 1, SIZE)
    return rows.withColumn(name, F.transform(least, lambda x: F.shiftright(x, 32).cast("int"))).drop(f"{name}_a")


def fingerprint(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both)).cast("double")


def _successors(rows: DataFrame) -> DataFrame:
    """k, next_k, half of every distinct document: which follows it in descending order, cyclically."""
    spark = rows.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("k")]
    ids = rows.select("doc_id", "k", "n_chars").distinct()
    parts = materialise(ids.repartitionByRange(shuffle_width(spark), *order).withColumn("part", F.spark_partition_id()), "order")
    within = Window.partitionBy("part").orderBy(*order)
    inner = parts.withColumn("next_k", F.lead("k").over(within))
    # a row for each range partition: its first document, and the first of the one after it
    firsts = parts.groupBy("part").agg(F.min_by("k", F.struct(F.col("doc_id").isNull(), -F.col("doc_id").cast("decimal(20,0)"), F.col("k"))).alias("first"))
    by_part = Window.orderBy("part")
    firsts = firsts.withColumn("after", F.coalesce(F.lead("first").over(by_part), F.first("first").over(by_part)))
    out = inner.join(F.broadcast(firsts), "part")
    return out.select("k", F.coalesce("next_k", "after").alias("next_k"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id of every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = own.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))
    links = materialise(_successors(own.withColumn("n_chars", F.length("text"))), "successors")
    repeated = own.select("k").count() != links.count()
    # dealt by k once: the plan below reads this exchange twice, so it has the same columns on both sides
    full = _with_sketch(own, "text", "sketch").select("k", "doc_id", "text", "sketch").repartition(shuffle_width(docs.sparkSession), "k")
    asked = full.select(F.col("k").alias("next_k"), F.col("doc_id").alias("next_doc_id"), F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch")).join(links, "next_k")
    asked = asked.select("k", "next_doc_id", F.left("next_text", "half").alias("prefix"), "next_sketch")
    if repeated:
        asked = asked.dropDuplicates(["k"])
    rows = full.join(asked, "k").withColumn("n_chars", F.length("text").cast("long"))
    kept = F.left("text", (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    rows = rows.select("doc_id", "next_doc_id", "n_chars", "sketch", "next_sketch", F.concat(kept, "prefix").alias("edited"))
    rows = _with_sketch(rows, "edited", "edited_sketch")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"), "next_doc_id")
