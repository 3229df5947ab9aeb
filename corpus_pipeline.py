"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, mixing. Part of the llm subpackage.

Every stage takes any table with doc_id, text, source and whatever else, passes the other columns on, and treats a row by its own
id and text: null ids, shared ids and repeated rows are judged like any other; a null text is kept by all but the last stages that
choose among equals (one row of all texts without words stays) or by size (rows without words aren't mixed in). Empty tables stay
empty. Whole texts are judged, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnflow.llm import decontaminate, linededup, mixing, shared, simhash, toxicity
from cairnflow.plans.session import ship


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained model rejects (score 0.5 or more) go; a null text scores as an empty one, ties at 0.5 go."""
    ship(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occurred before, or nearly so, leave the texts; all rows stay, null texts as they are."""
    ship(spark)
    return linededup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the smallest doc_id, nulls last, then the smallest row key."""
    ship(spark)
    return simhash.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a window of a benchmark item go, with or without an id."""
    ship(spark)
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each row, repeats counted, as `taken`; rows that it doesn't take go."""
    ship(spark)
    return mixing.mixed_documents(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("simhash", near_copies), ("decontamination", leaks), ("mixing", mixture)]
#: The first stage trains a model, which SQL can't express; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    try:
        for name, stage in STAGES[:-1]:
            path = shared.scratch_path(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                shared.remove_path(spark, before)
            before = path
        return shared.durable(STAGES[-1][1](spark, docs, sf_dir))  # so that nothing reads the last folder any more
    finally:
        if before:
            shared.remove_path(spark, before)
