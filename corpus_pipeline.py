"""Training corpus in five stages, each written and read again as the next one's documents.

1. quality: documents that the positive-unlabelled classifier rejects go.
2. lines: lines that three or more documents share stay in the document with the largest id only.
3. near_copies: of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays.
4. mix: documents are taken as often as entropy balancing to the source weights says.
5. pack: pieces of binary length, with their token ids.

All but the last return the columns of ``documents``; ``n_chars`` follows the text where lines have gone. Every stage takes
an empty table and null values as its operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.llm import balance, common, line_runs, near_dedup, packing, pu_quality

#: The classifier, the fit and the tokenizer have no counterpart in SQL; tests compare with a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = line_runs.drop_shared(docs, counts=("_n_lines", "_n_dropped"))
    changed = F.col("_n_dropped") > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rest = rest.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rest.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return balance.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
