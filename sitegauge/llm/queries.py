"""Registered queries of this subpackage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from sitegauge.llm import (
    decontamination, line_templates, merkle, minhash, mixing, ngram_trie, oracles, periodic, pii, quality_rules, repeats, suffixes,
    token_counts, token_files,
)
from sitegauge.llm.common import read_table
from sitegauge.session import ensure_checkpoint_dir

#: Sources are evened out towards 95 % of the greatest entropy, none being shown more than twice as often as another.
MIXTURE = mixing.Target(entropy=0.95, max_repeats=2.0)


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def token_output(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write a token folder beside the checkpoints and read it back."""
    folder = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid4().hex}"
    token_files.write_tokens(docs, folder)
    return token_files.read_tokens(spark, folder)


def op3_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, read_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(read_table(spark, sf_dir, "documents"), MIXTURE)


def op6_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(read_table(spark, sf_dir, "documents"))


def op7_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.recurring_lines(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read_table(spark, sf_dir, "documents"))


def op10_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score(read_table(spark, sf_dir, "documents"))


def op11_suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(read_table(spark, sf_dir, "documents")).drop("spans")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(periodic.with_planted_runs(read_table(spark, sf_dir, "documents")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"), merkle.damaged_text())


QUERIES = {
    f.__name__: f
    for f in (
        op1_template_decontamination, op2_token_counts, op3_bit_planes, op4_minhash, op5_temperature_mixing,
        op6_repeated_units, op7_pii_field, op8_line_templates, op9_quality_rules, op10_ngram_trie,
        op11_suffix_order, op12_periodic_runs, op13_merkle_manifest,
    )
}
ORACLES = {
    "op4_minhash": oracles.NEAR_DUPLICATES,
    "op8_line_templates": oracles.LINE_TEMPLATES,
    "op9_quality_rules": oracles.QUALITY,
    "op13_merkle_manifest": oracles.MANIFEST,
}
