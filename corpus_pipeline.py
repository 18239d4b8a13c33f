"""A corpus made ready for training: filters, dedup and packing in five stages.

Each stage takes (spark, docs, sf_dir), with docs the documents that the stage
before has kept, and returns a DataFrame that is written before the next
stage reads it.  All but the last return the columns of documents.  Labels
are read from sf_dir; what is learned is learned from each stage's own
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logspark.llm import common, neardup, packing, quality_fm, suffix_dedup, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    common.ship(spark)
    machine = quality_fm.fit(docs, common.labels(spark, sf_dir))
    out = common.unused(docs, "score"), common.unused(docs, "predicted")
    return quality_fm.score(docs, machine, out=out).where(f"`{out[1]}` = 1").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    common.ship(spark)
    grammar = toxicity.fit(docs, common.labels(spark, sf_dir))
    out = common.unused(docs, "score"), common.unused(docs, "predicted")
    return toxicity.score(docs, grammar, out=out).where(f"`{out[1]}` = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, resemblance 0.8 or more."""
    common.ship(spark)
    return neardup.deduplicate(docs).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out of the texts; all documents stay."""
    common.ship(spark)
    return suffix_dedup.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    common.ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("toxicity", toxic), ("minhash near-dedup", near_duplicates), ("suffix-array dedup", repeats), ("packing", pack)]

#: No stage is expressible in SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written to the shared checkpoint folder before the next."""
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs
