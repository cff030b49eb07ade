"""A text corpus from raw documents to a mixture: rules, near copies, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the
next stage's documents. All but the last give the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from portica.llm import decontaminate, mixing, ngram_join, quality_rules, suffix_dedup
from portica.llm.exchange import shared_folder
from portica.shipping import ship


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects. Null and empty texts fail; rows are judged by themselves."""
    return quality_rules.filter_documents(docs, "v2")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles.

    Of rows that are equal in all columns one stays; null ids come last; rows without words all stay.
    """
    return ngram_join.keep_representatives(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that repeat in the corpus; n_chars follows the text. All rows stay."""
    return suffix_dedup.remove_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; rows are judged by their text, null ones stay."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time that a document is read; rows without words are never read."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: Repeated byte strings have no practical SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the cluster's shared folder and read again.

    A stage's rows are removed once the next stage is written; those of the last are the result.
    """
    ship(spark)
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            _remove(spark, before)
        before = f"{top}/{name}"
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
