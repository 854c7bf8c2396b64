"""The corpus pipeline: language, near copies, leaks, mix, shards.

Every stage is one of the corpus operators and takes all rows that the stage before it kept; its result is written
as Parquet and read again as the next one's input. Documents leave for one of three reasons only: their language
can't be told (null, blank or letterless text), they are a near copy of a document with a smaller id, or they hold
a passage of the benchmark. The mix then repeats or leaves documents to meet its targets, and the last stage adds
slot and shard.

An empty table passes through all stages; a null id is a document of its own; repeated rows are copies, of which
the stage for near copies keeps all rows of the smallest id; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import decontam, jaccard_join, langid, mixing, sharding
from sievework.llm.common import new_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    model = langid.fit(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    return langid.keep_known(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream, in order; a document is there as often as the mix takes it."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stream with the shard of each document."""
    return sharding.shard(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("leaks", leaks), ("mixed", mixed), ("sharded", sharded)]

#: String kernels, fingerprints and connected components have no SQL form: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
