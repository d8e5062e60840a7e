"""From raw documents to packed sequences: five corpus operators as stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cindergrid.llm import common, mixing, orderhash, packing, passages, quality


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the factorisation machine does not reject."""
    model = quality.train(docs, common.read(spark, sf_dir, "labels"))
    return quality.score_texts(docs, model, keep=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the least doc_id."""
    return orderhash.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has."""
    return passages.without_passages(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that expected domain tokens reach the target weights; none is dropped."""
    return mixing.mix(docs, common.read(spark, sf_dir, "labels"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, with their ids."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality", reject_poor),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_domains),
    ("packing", pack),
]

#: Trained scores and hashed bands cannot be written as SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that remain; each stage is written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for number, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = common.stage(docs, name)
    return docs
