"""Sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, tune

CHUNK, PART_ROWS = 1 << 16, 250_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach): of n + 1 shards, 1 / (n + 1) of the keys move, all into the last."""
    state, at = keys.astype(np.uint64).copy(), np.zeros(len(keys), np.int64)
    nxt, active = np.zeros(len(keys), np.int64), np.arange(len(keys))
    while len(active):
        at[active] = nxt[active]
        state[active] = state[active] * np.uint64(2862933555777941757) + np.uint64(1)
        spread = float(1 << 31) / ((state[active] >> np.uint64(33)).astype(np.float64) + 1)
        nxt[active] = np.minimum((at[active] + 1) * spread, float(shards)).astype(np.int64)
        active = active[nxt[active] < shards]
    return at


def with_shards(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """rows with shard and grown_shard (with one shard more), both from the 64-bit column key alone."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    tune(rows.sparkSession)
    at, names = rows.columns.index(key), rows.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = part.column(at).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(jump(keys, n).astype(np.int32)) for n in (shards, shards + 1))], names=[*names, "shard", "grown_shard"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType())]))


def shard(docs: DataFrame, shards: int = 40, text: str = "text", id_: str = "doc_id", parts: int | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs; law is 'key'.

    id and the number of shards decide; rows of equal id (null ids too) share a shard. size: UTF-8 bytes and 16; a
    null text has none, and a null checksum counts as that of an empty text. Slots run from 0 in each shard. They are
    given in each of `parts` hash parts of a shard (64, and more where these would have over PART_ROWS rows), behind the sums of the
    parts before, so no task holds a whole shard; equal rows are counted before they are shuffled. Texts are not shuffled.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_).alias("id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    equal = narrow.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n"))
    keyed = equal.withColumn("key", F.xxhash64("id"))
    sharded = cut(with_shards(keyed, "key", shards))
    parts = parts or max(64, sharded.count() // (shards * PART_ROWS))
    dealt = sharded.withColumn("part", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(parts)).cast("int"))
    sums = dealt.groupBy("shard", "part").agg(F.sum("n").alias("rows"))  # shards x parts rows
    before = sums.select("shard", "part", (F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows")).alias("base"))
    order = Window.partitionBy("shard", "part").orderBy("id", "size", "text_crc32")
    placed = dealt.withColumn("first", F.sum("n").over(order) - F.col("n")).join(before, ["shard", "part"])
    chunked = placed.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    end = F.least(F.col("n"), F.col("begin") + CHUNK) - 1
    first = F.col("base") + F.col("first")
    slot = F.explode(F.sequence(first + F.col("begin"), first + end)).alias("slot")
    return chunked.select(F.col("id").alias(id_), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
