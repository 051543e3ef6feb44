"""What both vector searches share: valid vectors, shards with one index each, and queries streamed past them."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, tune



def valid(rows: DataFrame, id_: str, vector: str, zero: bool) -> DataFrame:
    """(vec_id, v, dim): vectors that take part, one for each id (of repeated ids the least vector). zero: whether zero vectors do."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.lit(True) if zero else F.exists(vector, lambda x: x != 0)
    kept = rows.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).where((F.size(vector) > 0) & finite & some)
    return kept.groupBy(F.col(id_).cast("long").alias("vec_id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v")).withColumn("dim", F.size("v"))


def pack_arrays(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack_arrays(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


#: A shard has LEAST_SHARD rows at least; a table of over SHARDS such shards has larger ones, up to MOST_SHARD rows or SHARE of an executor's memory.
LEAST_SHARD, MOST_SHARD, SHARDS, SHARE = 16_384, 262_144, 64, 0.05


def shard_size(vectors: DataFrame, rows: int) -> int:
    """Rows of a shard. Every query visits every shard, so shards grow with the table until one task's memory binds."""
    memory = vectors.sparkSession.sparkContext.getConf().get("spark.executor.memory", "1g").lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(memory[-1])
    bytes_ = int(memory[:-1]) << unit if unit else int(memory)
    wide = vectors.agg(F.max("dim")).first()[0] or 1
    return max(LEAST_SHARD, min(rows // SHARDS, MOST_SHARD, int(bytes_ * SHARE) // (12 * wide + 300)))


def build_shards(vectors: DataFrame, build: Callable[[np.ndarray, np.ndarray], bytes], shard_rows: int | None) -> tuple[DataFrame, int, int]:
    """((dim, shard, index), shards, rows a shard): vectors dealt by a hash of their id."""
    count = vectors.count()
    size = shard_rows or shard_size(vectors, count)
    shards = max(1, -(-count // size))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).repartition(min(4 * shards, 20_000), "dim", "shard")

    def make(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        order = np.argsort(ids := table.column("vec_id").to_numpy(), kind="stable")
        blob = build(ids[order], matrix(table.column("v"), dim)[order])
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "index": pa.array([blob], pa.binary())})

    return cut(dealt.groupBy("dim", "shard").applyInArrow(make, "dim int, shard int, index binary")), shards, size


BLOCK = "dim int, shard int, first long, ids binary, v binary, least binary, home binary"


def blocks(queries: DataFrame, to_home: bool) -> DataFrame:
    """BLOCK rows of queries(vec_id, v, dim, home, least): an Arrow batch's queries of one length packed together, with to_home those of one home shard, which is then `shard`."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, dim, home = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "dim", "home"))
            least, out = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64), []
            for key in sorted(set(zip(dim.tolist(), home.tolist() if to_home else [0] * len(dim)))):
                at = np.flatnonzero((dim == key[0]) & ((home == key[1]) | (not to_home)))
                v = matrix(part.column("v").take(pa.array(at)), key[0])
                out.append((key[0], key[1], int(ids[at[0]]), ids[at].tobytes(), v.tobytes(), least[at].tobytes(), home[at].astype(np.int32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=BLOCK.replace(",", "").split()[::2])

    tune(queries.sparkSession)
    return queries.select("vec_id", "v", "dim", "home", "least").mapInArrow(run, BLOCK)


def stream_queries(index: DataFrame, queries: DataFrame, search: Callable[[dict, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], copies: int, at_home: bool | None = None, shards: int = 1, score: str = "double") -> DataFrame:
    """(query_id, vec_id, score) of search(index, query ids, vectors, least scores) for queries(vec_id, v, dim, home, least).

    at_home: queries go to their home shard alone, or (False) to all others, or (None) to all. Each index goes to
    `copies` tasks; the queries, in blocks, are dealt among them and follow it: a task holds one index and one block.
    """
    tune(index.sparkSession)
    score_type = pa.float64() if score == "double" else pa.decimal128(38, 0)
    empty = F.lit(None).cast("binary")
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    first = index.select("dim", "shard", copy.alias("copy"), F.lit(0).alias("kind"), empty.alias("ids"), empty.alias("v"), empty.alias("least"), empty.alias("home"), "index")
    packed = blocks(queries, at_home is True)
    if at_home is not True:
        packed = packed.drop("shard").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    then = packed.select("dim", "shard", F.pmod(F.xxhash64("first", F.lit(7)), F.lit(copies)).cast("int").alias("copy"), F.lit(1).alias("kind"), "ids", "v", "least", "home", empty.alias("index"))
    spread = first.unionByName(then).repartition("dim", "shard", "copy").sortWithinPartitions("dim", "shard", "copy", "kind")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for part in parts:
            for kind, dim, shard, ids, v, least, home, blob in zip(*(part.column(c) for c in ("kind", "dim", "shard", "ids", "v", "least", "home", "index"))):
                if kind.as_py() == 0:
                    held, key = unpack_arrays(blob.as_py()), (dim.as_py(), shard.as_py())
                    continue
                if key != (dim.as_py(), shard.as_py()):
                    continue  # no vector of that length is in that shard
                who, bound = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(least.as_py(), np.float64)
                asked = np.frombuffer(v.as_py(), np.float64).reshape(-1, key[0])
                if at_home is False:
                    away = np.frombuffer(home.as_py(), np.int32) != key[1]
                    who, asked, bound = who[away], asked[away], bound[away]
                q, found, s = search(held, who, asked, bound)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found, pa.int64()), _scores(s, score_type)], names=["query_id", "vec_id", "score"])

    return spread.select("kind", "dim", "shard", "ids", "v", "least", "home", "index").mapInArrow(run, f"query_id long, vec_id long, score {score}")


def _scores(found, kind: pa.DataType) -> pa.Array:
    return pa.array(map(Decimal, found) if pa.types.is_decimal(kind) else found, kind)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
