"""The corpus pipeline: quality rules, line dedup, near-duplicates, benchmark
decontamination, packing.

Each stage takes what its predecessor kept, as written and read again, and
returns the columns of ``documents`` (the last one: packed pieces). Rejected,
emptied, duplicate and contaminated documents go; all others stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relaylake.llm.common import read_table, stored
from relaylake.llm.line_runs import dedup_lines
from relaylake.llm.mixture_packing import digest, pack_mixture
from relaylake.llm.odd_sketch_dedup import keep_one
from relaylake.llm.quality_mcd import keep_good
from relaylake.llm.wu_manber import drop_contaminated


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, percent=80, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest(pack_mixture(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# The fit and the tokenizer aren't SQL; each stage's operator is tested against
# brute force on its own.
ORACLE_SQL = None
