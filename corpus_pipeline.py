"""The corpus pipeline: language ID, near duplicates, decontamination, secrets and mixing, each over all that the stage before kept.

Each stage takes documents with at least doc_id, text, lang and source, and keeps all columns; those of other names may be anything. Null and empty
texts go in the first stage, so later ones meet none in a run; by itself each stage keeps them, but for the first. Rows with a null doc_id
are judged like others by language, secrets and mixing, and are neither near duplicates nor contaminated. Repeated rows of one doc_id share their
fate. Long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import decontaminate, jaccard, language, mixing, secrets
from pageloom.llm.shared import Tables, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no mixture of languages explains, or of which runs of signs take too large a share, go; null and empty texts too."""
    return language.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that n-gram Jaccard links connect, the one with the least doc_id stays."""
    return jaccard.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a run of words of a benchmark item go; with an empty benchmark none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what the rules match in it is masked. A null text stays null."""
    return secrets.mask(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by source, numbered in ``copy`` (a column of that name is replaced); the null source is a source like others."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_masking", secret_masking),
    ("source_mixing", source_mixing),
]
#: The language models are fitted and inferred by iteration, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tables = Tables(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.write(f"stage{k}", stage(spark, docs, sf_dir))
        tables.tidy()
        if k:
            tables.drop(f"stage{k - 1}")
    return docs
