"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import context_mixing, exact_dedup, fuzzy_lines, minhash_forest, mixing, quality, run_index, token_scan, toxicity, wu_manber
from .cluster import table
from .sql import SQL  # noqa: F401


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark, sf_dir):
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op4_fuzzy_lines(spark, sf_dir):
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left."""
    out = fuzzy_lines.line_results(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_token_counts(spark, sf_dir):
    return token_scan.token_counts(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_context_mixing(spark, sf_dir):
    return context_mixing.score_split(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op9_run_index(spark, sf_dir):
    return run_index.remove_repeats(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return wu_manber.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_context_mixing": op7_context_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_run_index": op9_run_index,
    "op10_decontamination": op10_decontamination,
}
