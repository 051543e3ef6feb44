"""A training-data pipeline over documents: toxicity, SimHash near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import mixing, packing, simhash, toxicity
from ledgerloom.llm.common import cut, drop_cut, release, scope, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under one half stay."""
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).where("toxicity < 0.5").select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: one of those with the group's smallest doc_id. Texts link by SimHash of five-word shingles, or where these are 0.8 alike."""
    return simhash.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come to their target weights."""
    return mixing.resample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents as sequences of binary lengths, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [("toxicity", toxic_out), ("simhash", near_copies_out), ("mixing", mixed), ("packing", packed)]

#: The learnt scores and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage but the last is written and read again, and what came before it is removed then."""
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for _, stage in before:
        with scope() as made:
            then = cut(stage(spark, docs, sf_dir))
        release(spark, made, then)
        drop_cut(docs)
        docs = then
    return last(spark, docs, sf_dir)
