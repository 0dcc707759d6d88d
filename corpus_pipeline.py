"""From raw documents to packed sequences, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows it keeps, all but
the last with the columns of ``documents``. Between stages the rows are written to the shared folder and read back,
so each stage is planned on what is there and a lost executor never reaches back beyond one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sediment.llm import minhash, mixing, packing, pii, quality_rules
from sediment.llm.common import discard, settled, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filtered(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target wants it."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their token ids."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Shingle components, boosted trees and token ids are not SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        discard(before)  # of two tables only the later one is read again
    return STAGES[-1][1](spark, docs, sf_dir)
