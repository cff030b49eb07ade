"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import ship
from . import conversation_repair, decontaminate, html_render, license_scan, lm_scoring, mixing, ngram_join, quality_net, quality_rules, simhash, suffix_dedup, token_align, toxicity
from .oracles import MIXING, ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents under a model of those that are not held out, trained to the end."""
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"), rounds=None)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, with the byte spans that the tags find."""
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the byte strings that repeat."""
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the strictest policy."""
    entries = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")), "v2")
    base = quality_rules.mask_of("base")
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return entries.select("doc_id", *measures, (entries["failed"].bitwiseAND(base) != 0).alias("base_failed"), "kept", "failed")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by their shingles."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def _mixed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    p = MIXING[name]
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), p["budget"], p["target_entropy"], p["max_repeats"], source_col=p["source"])
    return mixed.withColumn("weight", F.round("weight", 9))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half as many tokens again as the corpus has, over sources: two passes, the second one cut."""
    return _mixed(spark, sf_dir, "op6_mixing")


def mixing_languages_by_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages flattened until the entropy is reached."""
    return _mixed(spark, sf_dir, "mixing_languages_by_entropy")


def mixing_languages_by_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages flattened as far as the limit on repeats allows."""
    return _mixed(spark, sf_dir, "mixing_languages_by_repeats")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule: documents it fails, that only it rejects, and that would stay without it."""
    return quality_rules.ablations(quality_rules.ledger(_table(spark, sf_dir, "documents")), "v2")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licences of every document."""
    return license_scan.scan(license_scan.placed(_table(spark, sf_dir, "documents")))


def license_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path half alone: documents of a few words that name a licence speak for their directories."""
    docs = license_scan.placed(_table(spark, sf_dir, "documents"))
    name = F.when(F.contains("text", F.lit("Apache License")), "Apache-2.0").when(F.contains("text", F.lit("MIT License")), "MIT")
    places = docs.select(F.col("doc_id").alias("row"), "path", "text")
    own = places.select("row", name.alias("own_license"), F.lit(1.0).alias("similarity"), (F.length("text") < 1000).alias("is_license_file")).where("own_license IS NOT NULL")
    speakers = places.join(own.where("is_license_file"), "row").groupBy(license_scan.parent_of(F.col("path")).alias("dir")).agg(F.min("own_license").alias("dir_license"))
    out = license_scan.inherit(places.select("row", "path"), own, speakers)
    return out.select(F.col("row").alias("doc_id"), "path", "license", "inherited_from", F.col("depth").cast("bigint").alias("depth"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality_net.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_render.extract_text(_table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return conversation_repair.repair(_table(spark, sf_dir, "conversations"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers meet in every document."""
    return token_align.align_tokens(_table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those that differ in few bits."""
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_toxicity, op3_suffix_dedup, op4_quality_rules, quality_rule_ablations, op5_ngram_join, op6_mixing, mixing_languages_by_entropy, mixing_languages_by_repeats, op7_decontamination, op8_license_scan, license_inheritance, op9_quality_classifier, op10_html_text, op11_conversation_repair, op12_token_align, op13_simhash)
}

