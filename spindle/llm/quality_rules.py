"""Quality rules whose cutoffs are chosen under a guaranteed limit of false rejections.

Each rule rejects a document whose statistic (per mille) is above a cutoff. In each stratum (language) the labelled documents
of good quality are the holdout. A cutoff is certified if the exact binomial tail P(Bin(n, a) <= k) of its k false
rejections among n is at most d: then its true false-rejection rate is below a with confidence 1 - d. The
stratum's limit ``RISK`` is shared out over its rules (union bound), and ``ERROR`` over all chains of
cutoffs (Bonferroni); within a chain, cutoffs are tested from the most lenient on and testing stops
at the first failure (fixed sequence), which needs no further correction. A rule without a certified cutoff rejects nothing.

All of it is DataFrame expressions: window hashes by doubling over arrays, sorted only for the few
texts that repeat a window; the thresholds are a table of a row for each of the five strata, broadcast.

Null texts have no words and so fail the base rule. Labels other than 0 and 1 are ignored; an id with several
labels counts as good only if all are 1. Every row comes back, repeated ones too; a null doc_id is never labelled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, materialise

RISK, ERROR = 0.02, 0.05
STRATA = ("de", "en", "es", "fr")
SYMBOLS = "#*$%&|<>"
#: Cutoffs of each rule from strict to lenient, in per mille.
GRID = tuple(range(25, 525, 25))
RULES = ("symbols", "dup_lines", "repeats", "bare_lines")
#: Terms of a binomial tail that are summed one by one; what lies beyond is bounded by a geometric series.
TERMS = 4000


def base_statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, lang, the counts of the base rule and any ``carried`` columns, for each row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"), *carried)
    rows = rows.select("doc_id", "lang", "text", *carried, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    bare = F.translate("text", SPACES, "")
    # runs of 8 words by doubling; a column for each step, or inner arrays would be made anew for every use.
    # What lies past the last whole run is void and cut off below.
    rows = rows.withColumn("h0", F.transform("words", lambda w: F.xxhash64(w)))
    for i, span in enumerate((1, 2, 4)):
        pair = F.zip_with(f"h{i}", F.slice(f"h{i}", span + 1, F.greatest(F.size(f"h{i}"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        rows = rows.withColumn(f"h{i + 1}", pair).drop(f"h{i}")
    n = F.size("words").cast("long")
    rows = rows.select(
        "doc_id",
        "lang",
        *carried,
        n.alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: ~x.rlike(r"[.!?][\x20\x09-\x0D]*$"))).cast("long").alias("n_bare_lines"),
        F.slice("h3", 1, F.greatest(F.size("words") - 7, F.lit(0))).alias("runs"),
    )
    again = F.size(F.array_distinct("runs")) < F.size("runs")
    rows = rows.withColumn("found", F.when(again, F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: F.coalesce(x["h"] == F.get("found", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("found", k + 1)["h"], F.lit(False))
    rows = rows.withColumn("at", F.array_sort(F.transform(F.filter("found", twin), lambda x: x["i"])))
    covered = F.aggregate(F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(8)), F.lit(8))), F.lit(0), lambda s, x: s + x)
    return rows.withColumn("n_repeat_words", F.when(F.col("at").isNull(), 0).otherwise(covered).cast("long")).drop("runs", "found", "at")


def _per_mille(part: str, whole: str) -> Column:
    return F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("long")


def _statistics(rows: DataFrame, *carried: str) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stratum = F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise("other")
    return rows.select(
        *carried, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), stratum.alias("stratum"),
        _per_mille("n_symbols", "word_chars").alias("symbols"), _per_mille("n_dup_lines", "n_lines").alias("dup_lines"),
        _per_mille("n_repeat_words", "n_words").alias("repeats"), _per_mille("n_bare_lines", "n_lines").alias("bare_lines"),
    )


def _log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1, by Stirling's series at x + 10."""
    z = x + 10
    shift = sum((F.log(x + i) for i in range(1, 10)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k <= n p, summed from k downwards; 1 above that."""
    k, n = k.cast("double"), n.cast("double")
    term = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.least(k, F.lit(TERMS)).cast("int")
    odds = (1 - p) / p
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")),
        F.struct(term.alias("t"), term.alias("s")),
        lambda x, i: F.struct((x["t"] * (k - i) / (n - k + i + 1) * odds).alias("t"), (x["s"] + x["t"] * (k - i) / (n - k + i + 1) * odds).alias("s")),
    )
    left = k - steps
    ratio = left * odds / (n - left + 1)
    rest = F.when(left > 0, total["t"] * ratio / (1 - ratio)).otherwise(0.0)
    return F.when(k <= n * p, F.least(total["s"] + rest, F.lit(1.0))).otherwise(1.0)


def thresholds(statistics: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum and, for each rule, the strictest certified cutoff (null: none). At most a row for each stratum."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    good = good.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = statistics.where("not base_failed").join(good, "doc_id", "left_semi")
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r) > c).alias(f"{r}_{c}") for r in RULES for c in GRID])
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}").alias("k")) for r in RULES for c in GRID])
    rows = counts.select("stratum", "n", F.inline(tests))
    chains = (len(STRATA) + 1) * len(RULES)
    passed = rows.where(binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= error / chains)
    # a chain's tails only grow as its cutoffs get stricter, so the strictest that passes has all lenient ones before it
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_cut") for r in RULES])


def _with_verdict(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"{r}_cut"), F.lit(False))
    cuts = F.broadcast(cuts)  # five rows at most
    return rows.join(cuts, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, stratum of every row of ``docs``."""
    rows = materialise(_statistics(base_statistics(docs)), "statistics")
    out = _with_verdict(rows, thresholds(rows, labels, risk, error))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")


def accepted(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor a certified cutoff rejects, as they are.

    Statistics are taken once: the rows that pass the base rule are written with them, and read twice.
    """
    whole = F.struct(*docs.columns)
    beside = _statistics(base_statistics(docs.select("doc_id", "lang", "text", whole.alias("whole")), "whole"), "whole")
    # a filter on a column that isn't deterministic stays above it; pushed down, it would repeat the array expressions many times over
    beside = beside.withColumn("row", F.monotonically_increasing_id()).where("not base_failed and row >= 0").drop("row")
    rows = materialise(beside, "passed")
    cuts = materialise(thresholds(rows, labels, risk, error), "cuts")
    return _with_verdict(rows, cuts).where("kept").select("whole.*")
