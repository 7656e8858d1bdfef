"""A cleaning pipeline over `documents`: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fabrel.llm.common import Scratch, table
from fabrel.llm.decontaminate import decontaminated
from fabrel.llm.jaccard import one_of_each
from fabrel.llm.mixing import mixed
from fabrel.llm.quality import keep_quality, train
from fabrel.llm.shard import shard_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it is fitted on the labelled ones among docs."""
    return keep_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, that of the smallest id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows in which a benchmark item stands, those without an id too."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), by_row=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: not at all, once or twice."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, text_crc32, hilbert, shard and slot to the documents and all their columns, in runs of the Hilbert curve."""
    return shard_documents(docs, carry=docs.columns)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: None of the first three stages can be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each but the last written to the shared folder and read again; what a stage has read goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
