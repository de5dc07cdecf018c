"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return rows of
documents with the columns they came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candela.llm import best_fit_packing, exact_dedup, quality_rules, simhash_dedup, source_mixing
from candela.llm.common import discard, read, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the policy go."""
    return quality_rules.keep_good(docs, policy="v1")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints or by a similarity of 0.8 of five-word shingles, the smallest doc_id stays."""
    return simhash_dedup.drop_near_copies(docs, shingle=5, distance=4, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; rows of sources that are to weigh more repeat, twice at most."""
    return source_mixing.mix(docs, max_epochs=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048."""
    return best_fit_packing.pack(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mixing", mixing), ("best_fit_packing", packing)]

#: SQL can express neither the fingerprint links nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # cuts its lineage before it returns
    discard(spark, before)
    return out
