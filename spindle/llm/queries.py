"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, classifier, lines, minhash, packing, pii, quality_rules, substring, syncmers, token_counts
from .common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _on_labels(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": _on_labels(quality_rules.judged),
    "op2_hyperminhash": _on_documents(minhash.near_duplicates),
    "op3_closed_syncmers": _on_documents(syncmers.fingerprints),
    "op4_token_counts": _on_documents(lambda docs: token_counts.token_counts(docs, vocabulary("word_bpe_49k.json"))),
    "op5_relative_lz": _on_documents(substring.removed_repeats),
    "op6_best_fit": _on_documents(lambda docs: packing.packed(docs, vocabulary("word_bpe_49k.json"))),
    "op7_pii_anchors": _on_documents(pii.personal_data),
    "op8_fuzzy_lines": _on_documents(lines.line_report),
    "op9_attention_mil": _on_labels(classifier.quality_scores),
    "op10_bpe_ranks": _on_documents(lambda docs: bpe_codec.encode_and_decode(docs, vocabulary("byte_bpe_50k.json"))),
}
SQL: dict[str, str] = {}
