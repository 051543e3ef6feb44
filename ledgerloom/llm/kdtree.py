"""Exact top-k inner products with a KD-tree for each shard."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, release, scope
from .vectors import build_shards, nearest, pack_arrays, stream_queries, valid

LEAF = 64
#: Scores are whole numbers of up to 38 digits; greater ones end there.
SCORE, MOST = "decimal(38,0)", 10**38 - 1


def build(ids: np.ndarray, points: np.ndarray) -> bytes:
    """Median splits of the widest dimension down to leaves; each node has the tight box of its points."""
    order, nodes = np.arange(len(ids)), []  # (start, end, left, right)
    low, high = [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        here = points[order[start:end]]
        lo, hi = here.min(0), here.max(0)
        at = len(nodes)
        nodes.append([start, end, -1, -1])
        low.append(lo)
        high.append(hi)
        if parent >= 0:
            nodes[parent][2 + side] = at
        wide = int(np.argmax(hi - lo))
        if end - start > LEAF and hi[wide] > lo[wide]:
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(here[:, wide], half, kind="introselect")]
            todo += [(start, start + half, at, 0), (start + half, end, at, 1)]
    return pack_arrays(ids=ids[order], points=points[order], nodes=np.array(nodes, np.int64), low=np.array(low), high=np.array(high))


def _exact(bound: float) -> bool:
    """Whether float64 holds every partial sum of products under bound."""
    return bound < 2.0**53


def search(tree: dict, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-first over boxes: a box is opened while its greatest possible product reaches the k-th best so far.

    least: a score that the k-th best of other shards has reached already (NaN: none); lower ones are not looked for.
    Where products could leave what double precision holds exactly, scores are added up as Python's integers, and
    boxes' bounds are widened by their rounding error.
    """
    points, ids, nodes = tree["points"], tree["ids"], tree["nodes"].tolist()
    high = np.maximum(np.abs(tree["high"]), np.abs(tree["low"]))
    exact = not len(points) or _exact(float(high.max()) * float(np.abs(queries).max(initial=0)) * points.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = np.maximum(queries, 0) @ tree["high"].T + np.minimum(queries, 0) @ tree["low"].T
        if not exact:
            bounds = np.nan_to_num(bounds + (np.abs(queries) @ high.T) * (points.shape[1] + 4) * 2.0**-52, nan=np.inf, posinf=np.inf, neginf=np.inf)
    out: list[tuple[int, int, int]] = []
    for row, q in enumerate(queries):
        own, floor = int(query_ids[row]), float(least[row]) if least[row] == least[row] else -np.inf
        whole = [] if exact else [int(x) for x in q]
        best: list[tuple[float | int, int]] = []  # a heap of (score, -id)
        bound, heap = bounds[row], [(-float(bounds[row][0]), 0)]
        while heap and -heap[0][0] >= floor:
            start, end, left, right = nodes[heapq.heappop(heap)[1]]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-float(bound[child]), child))
                continue
            if exact:
                scores = points[start:end] @ q
                hits = [(float(scores[i]), i) for i in np.flatnonzero(scores >= floor).tolist()]
            else:
                hits = [(sum(x * int(y) for x, y in zip(whole, points[i])), i - start) for i in range(start, end)]
                hits = [x for x in hits if x[0] >= floor]
            for score, i in hits:
                found = (score, -int(ids[start + i]))
                if -found[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k:
                floor = max(floor, best[0][0])
        out += [(own, -i, max(-MOST, min(MOST, int(s)))) for s, i in best]
    q, v, s = zip(*out) if out else ((), (), ())
    return np.array(q, np.int64), np.array(v, np.int64), list(s)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_: str = "vec_id", vector: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of each query with all other rows, ties to smaller ids.

    rows and queries(id, vector) hold integers (as any number type); scores are decimal(38,0) and exact, of vectors
    whose products double precision can't hold, too.
    Vectors that are null, empty or hold null or non-finite components take no part; vectors of another length than
    the query's are no candidates; zero vectors are. Of rows that repeat an id, one counts. Shards hold about
    shard_rows vectors (by default shard_size). Each query first searches one shard; its k-th best there goes with
    it to the others, which skip every box that can't reach it. Empty tables give no rows.
    """
    with scope() as made:
        index, shards, _ = build_shards(cut(valid(rows, id_, vector, zero=True)), build, shard_rows)
    release(rows.sparkSession, made, index)
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    asked = cut(valid(queries, id_, vector, zero=True).select("vec_id", "v", "dim", home.alias("home"), F.lit(None).cast("double").alias("least")))
    copies = max(1, -(-asked.count() // 20_000))
    find = lambda tree, ids, qs, least: search(tree, ids, qs, least, k)
    at_home = cut(stream_queries(index, asked, find, copies, True, shards, SCORE))
    if shards == 1:
        drop_cut(index)
        drop_cut(asked)
        return nearest(at_home, k)
    reached = at_home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("s")).where(F.col("n") == k)
    reached = reached.select(F.col("query_id").alias("vec_id"), (F.col("s") - F.abs("s") * 2.0**-52).alias("least"))  # never above the exact score
    others = asked.drop("least").join(reached, "vec_id", "left")
    return nearest(at_home.unionByName(stream_queries(index, others, find, copies, False, shards, SCORE)), k)
