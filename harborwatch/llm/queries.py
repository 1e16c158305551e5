"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.llm import (
    alignment, balance, common, fixity, html_text, interleave, language, line_runs, near_dedup, oracles, packing, pu_quality,
    repetition, threshold_search, variants,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(documents(spark, sf_dir))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_text.main_text(pages, html_text.fit(pages))


def op3_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(documents(spark, sf_dir), size=3, percent=85)


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pu_quality.score(docs, pu_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived twice; the second copy is damaged by a rule, and the audit must find where."""
    segments = fixity.write_segments(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    replica = common.materialise(fixity.damaged_copy(segments), "replica")
    height = fixity.height_of(segments)
    trees = [fixity.tree(s, height) for s in (segments, replica)]
    return fixity.located(segments, fixity.audit(*trees))


def op7_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = balance.copies(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_identify(documents(spark, sf_dir))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = line_runs.drop_shared(documents(spark, sf_dir).select("doc_id", "text"))
    return rest.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op11_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave.assign(documents(spark, sf_dir))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_aligned(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_repetition, op2_html_text, op3_threshold_search, op4_near_dedup, op5_pu_quality, op6_fixity, op7_balance, op8_language,
    op9_line_runs, op10_packing, op11_interleave, op12_variants, op13_alignment)}
ORACLES: dict[str, str] = {
    "op1_repetition": oracles.repeats(), "op3_threshold_search": threshold_search.ORACLE,
    "op4_near_dedup": oracles.near_copies(3, 85), "op9_line_runs": oracles.shared_lines(),
    "op11_interleave": oracles.interleaved(), "op12_variants": oracles.spelling_variants()}
