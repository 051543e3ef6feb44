"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hnsw, html_extract, kdtree, licenses, mixing, packing, sharding, simhash, sql, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("toxic_passages").alias("passages"))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return hnsw.neighbours(rows, rows.where("vec_id % 20 = 0"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A null or non-finite component stays one, so that the operator leaves its vector out. From 2^53 on every double is whole.
    scaled = lambda x: x.cast("double") * 256
    floor = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).when(F.abs(y) < float("inf"), y)
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: floor(scaled(x))).alias("embedding"))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    score = F.greatest(-most - 1, F.least(most, F.col("score")))  # the contract's long ends there
    return kdtree.top_k(rows, rows.where("vec_id % 50 = 0")).withColumn("score", score.cast("long"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_conversations(chat.fold(chat.from_turns(rows.unionByName(extra)))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity, op2_hnsw, op3_mixing, op4_html, op5_licenses, op6_kdtree, op7_packing, op8_simhash, op9_sharding, op10_chat)
}

#: Queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op5_licenses": sql.LICENSES, "op6_kdtree": sql.TOP_K, "op10_chat": sql.CHAT}
