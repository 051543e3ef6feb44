"""Links between texts of high resemblance: MinHash bands retrieve them, longer sketches sift them, their sets of shingles decide.

A stage on five-word shingles needs this beside SimHash: at a Jaccard similarity of 0.8 two 64-bit fingerprints differ
in 10 bits on average, where no pigeonhole allocation over 64 bits is selective.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

HASHES, ROWS, BANDS = 1024, 4, 16  # 16 bands of 4 rows: a pair at 0.8 meets in one with probability 0.9998
MARGIN = 0.07  # sketches sift at so much less than the similarity asked for: 4.6 standard deviations at 0.8
SPOOL_BYTES, COMPARE = 64 << 20, 1 << 20  # a family's sets go to a local file beyond so many bytes; so many hashes are compared at once
REDEAL_ROWS, REDEAL_KEYS = 2, 16  # a bucket over the limit is dealt out by 16 keys of 2 further rows: 0.8 meets with probability 1 - 1e-7
_random = np.random.Generator(np.random.PCG64(8))
_MASKS = _random.integers(0, 1 << 32, HASHES, np.uint32)
_FACTORS = _random.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)


def least_hashes(hashes: list[int]) -> np.ndarray:
    """The least value of a set of 64-bit hashes under each of HASHES functions."""
    short = (np.unique(np.array(hashes, np.uint64)) >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 64):
        np.minimum(least, ((short[i : i + 64, None] ^ _MASKS) * _FACTORS).min(0), out=least)
    return least


def _keys(least: np.ndarray, start: int, rows: int, count: int) -> list[int]:
    """A 64-bit signed key for each of count groups of rows."""
    return [xxhash.xxh64_intdigest(least[start + j * rows : start + (j + 1) * rows].tobytes(), j) - (1 << 63) for j in range(count)]


def sketch(hashes: list[int]) -> tuple[list[int], list[int], bytes] | None:
    """(band keys, keys to deal large buckets out by, two bits of each least hash); none of no hashes."""
    if not hashes:
        return None
    least = least_hashes(hashes)
    low = (least ^ least >> np.uint32(11) ^ least >> np.uint32(22)) & np.uint32(3)
    four = low.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint32)
    return _keys(least, 0, ROWS, BANDS), _keys(least, ROWS * BANDS, REDEAL_ROWS, REDEAL_KEYS), four.sum(1).astype(np.uint8).tobytes()


def alike(rest: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """Which rows of sketches agree with one as sets of that similarity would: two bits of different hashes agree once in four."""
    apart = rest ^ at
    differ = np.bitwise_count((apart | apart >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1, dtype=np.int64)
    return differ <= (1 - similarity) * 0.75 * HASHES


def links_of_bucket(nodes: np.ndarray, sketches: np.ndarray, similarity: float, verify: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """Links that join up every alike pair in a bucket, on demand of those that verify confirms: a breadth-first search over those not yet reached."""
    while len(nodes) > 1:
        queue, nodes, sketches = [(nodes[0], sketches[0])], nodes[1:], sketches[1:]
        while queue and len(nodes):
            node, at = queue.pop()
            hit = alike(sketches, at, similarity)
            if verify and hit.any():
                hit[hit] = verify(int(node), nodes[hit])
            if hit.any():
                for x, s in zip(nodes[hit], sketches[hit]):
                    yield int(node), int(x)
                    queue.append((x, s))
                nodes, sketches = nodes[~hit], sketches[~hit]


def families_of_bucket(nodes: np.ndarray, sketches: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """(family, node): what alike pairs of a bucket connect. Equal families of several buckets have one name."""
    root: dict[int, int] = {}
    for a, b in links_of_bucket(nodes, sketches, similarity):
        root[b] = root.setdefault(a, a)
    members: dict[int, list[int]] = {}
    for x, r in root.items():
        members.setdefault(r, []).append(x)
    for family in members.values():
        name = xxhash.xxh64_intdigest(np.sort(np.array(family, np.int64)).tobytes()) - (1 << 63)
        yield from ((name, x) for x in family)


def _search(similarity: float, of_bucket: Callable):
    """For mapInArrow over (bucket, node, sketch) sorted by bucket: a task holds one bucket and one batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sketches = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, HASHES // 32), np.uint64)

        def settle(ends: list[int]) -> Iterator[pa.RecordBatch]:
            found = [pair for a, b in zip(ends, ends[1:]) if b - a > 1 for pair in of_bucket(nodes[a:b], sketches[a:b], similarity)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

        for part in parts:
            k, n = (part.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            s = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64).reshape(-1, HASHES // 32)
            key, nodes, sketches = np.concatenate((key, k)), np.concatenate((nodes, n)), np.concatenate((sketches, s))
            ends = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            yield from settle(ends)
            key, nodes, sketches = key[ends[-1] :], nodes[ends[-1] :], sketches[ends[-1] :]
        yield from settle([0, len(nodes)])

    return run


class Sets:
    """Sets of 64-bit hashes by position, in memory up to SPOOL_BYTES and then in a local file without a name."""

    def __init__(self) -> None:
        self.file, self.ends = tempfile.SpooledTemporaryFile(SPOOL_BYTES), [0]

    def add(self, hashes: list[int]) -> None:
        self.file.seek(self.ends[-1] * 8)
        found = np.unique(np.array(hashes, np.uint64))
        self.file.write(found.tobytes())
        self.ends.append(self.ends[-1] + len(found))

    def get(self, i: int) -> np.ndarray:
        self.file.seek(self.ends[i] * 8)
        return np.frombuffer(self.file.read((self.ends[i + 1] - self.ends[i]) * 8), np.uint64)

    def alike(self, similarity: float, at: int, others: np.ndarray) -> np.ndarray:
        """Which of the others have a Jaccard similarity of at least that with one; none of them is empty."""
        mine, ends = self.get(at), np.array(self.ends)
        sizes = ends[others + 1] - ends[others]
        out = np.minimum(sizes, len(mine)) / np.maximum(sizes, len(mine)) >= similarity
        fit = np.flatnonzero(out)
        for few in np.split(fit, np.flatnonzero(np.diff(np.cumsum(sizes[fit]) // COMPARE)) + 1):
            if len(few):
                theirs = np.concatenate([self.get(i) for i in others[few]])
                place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                both = np.add.reduceat((mine[place] == theirs).astype(np.int64), np.cumsum(sizes[few]) - sizes[few])
                out[few] = both / (len(mine) + sizes[few] - both) >= similarity
        return out


def _verify(similarity: float, hashes_of: Callable[[str], list[int]]):
    """For mapInArrow over (family, node, sketch, text) sorted by family: a task holds the sketches of one family, and its sets in a spool."""

    def links(nodes: list[int], sketches: list[bytes], sets: Sets) -> list[tuple[int, int]]:
        drawn = np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, HASHES // 32)
        with sets.file:
            found = list(links_of_bucket(np.arange(len(nodes)), drawn, similarity - MARGIN, lambda at, others: sets.alike(similarity, at, others)))
        return [(nodes[a], nodes[b]) for a, b in found]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, nodes, sketches, sets = None, [], [], Sets()
        for part in parts:
            found = []
            for name, node, drawn, text in zip(*(part.column(i) for i in range(4))):
                if name.as_py() != family:
                    found += links(nodes, sketches, sets)
                    family, nodes, sketches, sets = name.as_py(), [], [], Sets()
                nodes.append(node.as_py())
                sketches.append(drawn.as_py())
                sets.add(hashes_of(text.as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
        found = links(nodes, sketches, sets)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return run


#: What is looked up by 64-bit keys is broadcast up to so many rows (16 to 24 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def _looked_up(rows: DataFrame) -> DataFrame:
    """rows, cut, and broadcast to a join if they are counted to be few."""
    kept = cut(rows)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def similar_texts(nodes: DataFrame, similarity: float = 0.8, bucket_limit: int = 32_768, texts: DataFrame | None = None, hashes_of: Callable[[str], list[int]] | None = None) -> DataFrame:
    """(a, b): links that connect the nodes(node, bands, more, sketch) whose sets are `similarity` alike or more.

    With texts(node, text, sketch, more) and hashes_of, which gives the hashes of a text, the sets themselves decide: sketches
    only gather the families, MARGIN wider, in which they are compared (and nodes need no more). Without, likeness is
    read off the sketches, with a standard deviation of 0.015 at 0.8. Only rows that share a bucket move with their
    sketch, of buckets with equal members those of one, and only members of families with their text (all do where
    members are over BROADCAST_ROWS). A bucket is searched in one task up to bucket_limit rows; a larger one is dealt out
    again by the rows that its band does not use, level by level; at the last level, whose rows agree in ten least
    hashes, a bucket is held whole, 264 bytes a row. Null sketches link nothing; no nodes give no links.
    """
    with_key = nodes.where("sketch is not null")
    level = with_key.select("node", F.explode("bands").alias("bucket"))
    search = _search(similarity, links_of_bucket) if texts is None else _search(similarity - MARGIN, families_of_bucket)
    links = None
    for depth in range(4):
        level = cut(level) if depth else level
        who = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"who{k}") for k in range(2)]  # names a bucket's members
        sizes = cut(level.groupBy("bucket").agg(F.count("*").alias("n"), *who).where("n > 1"))
        small = sizes if depth == 3 else sizes.where(F.col("n") <= bucket_limit)
        # Near copies share many bands, whose buckets have the same members: one of them is enough.
        one = _looked_up(small.groupBy("n", "who0", "who1").agg(F.min("bucket").alias("bucket")).select("bucket"))
        pairs = _looked_up(level.join(one, "bucket").select("bucket", "node"))
        rows = with_key.select("node", "sketch").join(pairs, "node").select("bucket", "node", "sketch")
        here = cut(rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(search, "a long, b long").distinct())
        links = here if links is None else links.union(here)
        large = sizes.where(F.col("n") > bucket_limit)
        if depth == 3 or large.isEmpty():
            break
        wide = level.join(large.select("bucket"), "bucket").join((with_key if texts is None else texts).select("node", "more"), "node")
        level = wide.select("node", F.explode(F.transform("more", lambda k: F.xxhash64("bucket", k))).alias("bucket")).distinct()
    if texts is None:
        return links
    members = _looked_up(links.toDF("family", "node").distinct())
    spread = texts.join(members, "node").select("family", "node", "sketch", "text").repartition("family").sortWithinPartitions("family", "node")
    return cut(spread.mapInArrow(_verify(similarity, hashes_of), "a long, b long").distinct())
