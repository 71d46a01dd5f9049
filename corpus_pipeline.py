"""From raw documents to a training mix, one operator per stage, each written and read again."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gridcast.functions.scale_out import settle  # noqa: E402
from gridcast.llm import decontaminate, language_id, line_dedup, mixing, simhash  # noqa: E402
from gridcast.llm.common import table  # noqa: E402


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language shows; the others go."""
    model = language_id.learn(docs)
    return language_id.identify(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document only; ``n_chars`` follows the text."""
    done = line_dedup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [("language ID", language_stage), ("line dedup", line_stage), ("SimHash near-dedup", near_duplicate_stage),
          ("benchmark decontamination", decontamination_stage), ("source mix", mixing_stage)]
ORACLE_SQL = None                     # compression and SimHash are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
