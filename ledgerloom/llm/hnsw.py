"""Approximate nearest neighbours: one hierarchical navigable small-world graph for each shard, as flat arrays."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, scope
from .vectors import LEAST_SHARD, build_shards, nearest, pack_arrays, stream_queries, valid

DEGREE, BEAM_BUILD, BEAM_SEARCH, OPENED, BATCH = 32, 128, 192, 4, 256


def _beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), best first, -1 where fewer: a best-first walk of many queries at once; entry: [queries, some] nodes."""
    n, m = len(queries), links.shape[1]
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, len(points) + 1), bool)  # the last column takes the -1s
    seen[:, -1] = True
    seen[rows, entry] = True
    ids = np.full((n, beam), -1, np.int32)
    sims = np.full((n, beam), -np.inf, np.float32)
    width = min(entry.shape[1], beam)
    ids[:, :width] = entry[:, :width]
    sims[:, :width] = np.where(entry[:, :width] >= 0, np.einsum("qd,qkd->qk", queries, points[entry[:, :width]]), -np.inf)
    opened = ids < 0
    live = np.arange(n)
    while len(live):
        pending = np.where(opened[live], -np.inf, sims[live])
        pick = np.argpartition(-pending, min(OPENED, beam) - 1, axis=1)[:, :OPENED]
        useful = np.take_along_axis(pending, pick, 1) > -np.inf
        go = useful.any(1)
        live, pick, useful = live[go], pick[go], useful[go]
        if not len(live):
            break
        at = live[:, None]
        frontier = np.where(useful, ids[at, pick], -1)
        opened[at, pick] = True
        new = np.where(frontier[:, :, None] >= 0, links[frontier], -1).reshape(len(live), -1)
        new[seen[at, new]] = -1
        new.sort(axis=1)  # the same node may be linked from several that were opened
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        seen[at, new] = True
        near = np.where(new >= 0, np.einsum("qd,qkd->qk", queries[live], points[new]), -np.inf).astype(np.float32)
        all_sims = np.concatenate((sims[live], near), 1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate((ids[live], new.astype(np.int32)), 1), keep, 1)
        sims[live] = np.take_along_axis(all_sims, keep, 1)
        opened[live] = np.take_along_axis(np.concatenate((opened[live], new < 0), 1), keep, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(points: np.ndarray, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (best first, -1: none), up to `most` that are nearer to the centre than to any one taken; then the nearest others."""
    n, c = nodes.shape
    vectors = points[nodes]
    between = np.einsum("qid,qjd->qij", vectors, vectors)
    taken = np.zeros((n, c), bool)
    for j in range(c):
        closest = np.where(taken, between[:, j, :], -np.inf).max(1)
        taken[:, j] = (nodes[:, j] >= 0) & (sims[:, j] > closest) & (taken.sum(1) < most)
    rank = np.where(taken, 0, np.where(nodes >= 0, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.full((n, most), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(nodes, order, 1)
    return out


def _link(points: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Link new nodes to those chosen, and those back, each keeping a diverse list of its own."""
    links[new] = chosen
    source = np.repeat(new, chosen.shape[1])
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, start, count = np.unique(target, return_index=True, return_counts=True)
    for size in np.unique(np.minimum(1 << np.ceil(np.log2(count)).astype(int), 1 << 20)):
        some = (1 << np.ceil(np.log2(count)).astype(int)) == size
        mine, at, n = nodes[some], start[some], count[some]
        place = np.arange(size)[None, :]
        incoming = np.where(place < n[:, None], source[np.minimum(at[:, None] + place, len(source) - 1)], -1).astype(np.int32)
        for a in range(0, len(mine), 512):
            both = np.concatenate((links[mine[a : a + 512]], incoming[a : a + 512]), 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = np.where(both >= 0, np.einsum("qd,qkd->qk", points[mine[a : a + 512]], points[both]), -np.inf)
            near = np.argsort(-sims, axis=1, kind="stable")
            links[mine[a : a + 512]] = _diverse(points, np.take_along_axis(both, near, 1), np.take_along_axis(sims, near, 1), links.shape[1])


def build(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """The graph over distinct vectors; equal ones hang on one node. Levels come from a hash of the id, so a rerun builds the same graph."""
    distinct, of = np.unique(vectors, axis=0, return_inverse=True)
    by_node = np.argsort(of.ravel(), kind="stable")  # ids of a node stay in order
    first = np.searchsorted(of.ravel()[by_node], np.arange(len(distinct) + 1))
    lead = ids[by_node[first[:-1]]]
    chance = np.array([(xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True)) + 1) / 2**64 for i in lead])
    level = np.minimum((-np.log(chance) / np.log(DEGREE)).astype(int), 6)
    order = np.argsort(-level, kind="stable")
    level, distinct, lead = level[order], distinct[order], lead[order]
    size = (first[1:] - first[:-1])[order]
    members = np.concatenate([by_node[first[i] : first[i + 1]] for i in order]) if len(order) else by_node
    # One more dimension makes all lengths equal, so that the greatest product is the nearest point.
    norms = (distinct**2).sum(1)
    scale = float(np.sqrt(norms.max(initial=0))) or 1.0
    points = np.concatenate((distinct / scale, np.sqrt(np.maximum(0, 1 - norms / scale**2))[:, None]), 1).astype(np.float32)
    graphs: dict[str, np.ndarray] = {}
    above: list[np.ndarray] = []
    for at in range(int(level.max(initial=0)), -1, -1):
        n = int((level >= at).sum())
        degree = DEGREE * (2 if at == 0 else 1)
        links = np.full((n, degree), -1, np.int32)
        begin = 1
        while begin < n:
            new = np.arange(begin, min(n, begin + min(BATCH, max(1, begin))))
            batch = points[new]
            entry = _descend(points, above, batch)
            entry = np.where(entry < begin, entry, 0)
            found, sims = _beam(points[:begin], links[:begin], batch, entry, BEAM_BUILD)
            peers = batch @ batch.T  # nodes of one batch see each other, too
            np.fill_diagonal(peers, -np.inf)
            side = min(16, len(new) - 1)
            if side:
                best = np.argpartition(-peers, side - 1, axis=1)[:, :side]
                found = np.concatenate((found, new[best].astype(np.int32)), 1)
                sims = np.concatenate((sims, np.take_along_axis(peers, best, 1)), 1)
                near = np.argsort(-sims, axis=1, kind="stable")
                found, sims = np.take_along_axis(found, near, 1), np.take_along_axis(sims, near, 1)
            chosen = _diverse(points, found, sims, DEGREE)
            wide = np.full((len(new), degree), -1, np.int32)
            wide[:, : chosen.shape[1]] = chosen
            _link(points, links, new, wide)
            begin = int(new[-1]) + 1
        graphs[f"links{at}"] = links
        above.append(links)
    return pack_arrays(points=points, vectors=distinct, scale=np.array([scale]), size=size, members=ids[members], levels=np.array([len(above)]), **graphs)


def _descend(points: np.ndarray, above: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """The nodes to enter the next level by: a narrow beam down the levels above."""
    entry = np.zeros((len(queries), 1), np.int64)
    for links in above:
        found, _ = _beam(points[: len(links)], links, queries, entry, 8)
        entry = np.where(found[:, :4] >= 0, found[:, :4], found[:, :1]).astype(np.int64)
        entry[:, 1:][entry[:, 1:] == entry[:, :1]] = -1
    return entry


def search(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int = BEAM_SEARCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best that the walk finds for each query, but itself; scores from the original vectors in double precision."""
    graphs = [index[f"links{i}"] for i in range(int(index["levels"][0]) - 1, -1, -1)]
    points, vectors = index["points"], index["vectors"]
    start = np.concatenate(([0], np.cumsum(index["size"])))
    out: list[tuple[int, int, float]] = []
    for a in range(0, len(queries), BATCH):
        part = queries[a : a + BATCH]
        norm = np.sqrt((part**2).sum(1, keepdims=True))
        wide = np.concatenate((part / np.where(norm > 0, norm, 1), np.zeros((len(part), 1))), 1).astype(np.float32)
        found, _ = _beam(points, graphs[-1], wide, _descend(points, graphs[:-1], wide), max(beam, k + 1))
        exact = np.where(found >= 0, np.einsum("qd,qkd->qk", part, vectors[found]), -np.inf)
        for row, own in enumerate(query_ids[a : a + BATCH].tolist()):
            best: list[tuple[float, int]] = []
            for j in np.argsort(-exact[row], kind="stable").tolist():
                if found[row, j] < 0 or len(best) >= k and -best[k - 1][0] > exact[row, j]:
                    break
                node = int(found[row, j])
                best += [(-float(exact[row, j]), i) for i in index["members"][start[node] : min(start[node + 1], start[node] + k + 1)].tolist() if i != own]
            out += [(own, i, -s) for s, i in sorted(best)[:k]]
    q, v, s = zip(*out) if out else ((), (), ())
    return np.array(q, np.int64), np.array(v, np.int64), np.array(s, np.float64)


def beam_for(shard_rows: int) -> int:
    """Larger graphs need a wider walk for the same recall: half as much again for each fourfold size."""
    return int(BEAM_SEARCH * max(1.0, 1 + np.log2(max(1, shard_rows / LEAST_SHARD)) / 4))


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 20, id_: str = "vec_id", vector: str = "embedding", shard_rows: int | None = None, beam: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by inner product that the graphs find for each query, best first, ties to smaller ids.

    Every valid row is in one shard's graph; every query walks every shard, and the shards' results are merged. Shards
    hold about shard_rows vectors (by default shard_size), walks keep `beam` candidates (by default beam_for).
    Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of another length
    than the query's are no candidates. Of rows that repeat an id, one counts; equal vectors under several ids are one
    node and all of its ids are results. Empty tables give no rows.
    """
    with scope() as made:
        vectors = cut(valid(rows, id_, vector, zero=False))
        nothing = [F.lit(0).alias("home"), F.lit(None).cast("double").alias("least")]
        asked = cut(valid(queries, id_, vector, zero=False).select("vec_id", "v", "dim", *nothing))
        index, shards, size = build_shards(vectors, build, shard_rows)
    release(rows.sparkSession, made, index, asked)
    width, copies = beam or beam_for(size), max(1, -(-asked.count() // 20_000))
    return nearest(stream_queries(index, asked, lambda index, ids, qs, _: search(index, ids, qs, k, width), copies, None, shards), k)
