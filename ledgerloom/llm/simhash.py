"""SimHash near-duplicates by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import resemblance
from .common import cut, release, scope, tune
from .components import connected_components

BITS = 64


# ---- fingerprints


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> list[int]:
    """XXH64 of every word shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[i:j], seed) for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """The 64-bit SimHash: bits set in over half the hashes; 0 of none."""
    if not hashes:
        return 0
    all_, total = np.array(hashes, np.uint64), np.zeros(BITS, np.int64)
    for i in range(0, len(all_), 1 << 15):
        part = all_[i : i + (1 << 15)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * total > len(all_), bitorder="little").view(np.uint64)[0])


def set_digest(hashes: list[int]) -> bytes:
    """128 bits that name a set of hashes, whatever their order and repeats."""
    return xxhash.xxh3_128_digest(np.unique(np.array(hashes, np.uint64)).tobytes())


SKETCH = T.StructType([T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("more", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("digest", T.BinaryType())])


def with_fingerprints(docs: DataFrame, text: str, keep: list[str], width: int = 3, sketches: bool = False) -> DataFrame:
    """keep's columns and fp, the fingerprint as a signed 64-bit number, and on demand s, a sketch of the same shingles and a digest of their set."""
    tune(docs.sparkSession)
    frame, at = (docs.select(*keep), keep.index(text)) if text in keep else (docs.select(*keep, text), len(keep))
    schema = T.StructType([*(frame.schema[c] for c in keep), T.StructField("fp", T.LongType()), *[T.StructField("s", SKETCH)] * sketches])
    sketch_type = pa.struct([("bands", pa.list_(pa.int64())), ("more", pa.list_(pa.int64())), ("sketch", pa.binary()), ("digest", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made, drawn = [], []
            for x in part.column(at):
                hashes = shingle_hashes(x.as_py(), width)
                made.append(fingerprint(hashes))
                if sketches:
                    got = resemblance.sketch(hashes)
                    drawn.append(got and dict(zip(SKETCH.names, (*got, set_digest(hashes)))))
            arrays = [*(part.column(i) for i in range(len(keep))), pa.array(np.array(made, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(drawn, sketch_type)] * sketches], names=schema.names)

    return frame.mapInArrow(run, schema)


# ---- plan: partitions of bits, and a threshold for each


def correlated_partitions(bits: np.ndarray, count: int) -> list[list[int]]:
    """Deal bit positions into count groups of like size; each group takes the bits most correlated with those it has."""
    spread = bits.std(0)
    centred = (bits - bits.mean(0)) / np.where(spread > 0, spread, 1)
    tied = np.abs(centred.T @ centred) / max(1, len(bits))
    free, groups = list(range(BITS)), []
    for k in range(count):
        size = len(free) // (count - k)
        group = [min(free, key=lambda b: (spread[b], b))]  # the least even bit: skew gathers in few groups
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (tied[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def expected_collisions(bits: np.ndarray, group: list[int], most: int) -> list[float]:
    """For e = 0..most, the share of pairs that differ in at most e bits of a group: independent bits, and what the sample itself shows."""
    same = bits[:, group].mean(0) ** 2 + (1 - bits[:, group].mean(0)) ** 2
    odds = np.zeros(most + 2)
    odds[0] = 1
    for s in same:
        odds = odds * s + np.concatenate(([0], odds[:-1])) * (1 - s)
        odds[-1] = 0
    model = np.cumsum(odds[: most + 1])
    seen = np.zeros(most + 1)
    signs, n = 2 * bits[:1024, group] - 1, min(len(bits), 1024)
    if n > 1:
        apart = (len(group) - signs @ signs.T) / 2
        seen = np.array([((apart <= e).sum() - n) / (n * (n - 1)) for e in range(most + 1)])
    return [float(max(a, b)) for a, b in zip(model, seen)]


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = budget and the least cost, by dynamic programming; costs[i][t + 1] is the price of t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for price in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, taken) in best.items():
            for t, c in enumerate(price):
                if used + t <= budget and (used + t not in grown or cost + c < grown[used + t][0]):
                    grown[used + t] = (cost + c, [*taken, t - 1])
        best = grown
    return best.get(budget, (float("inf"), []))


def plan(sample: list[int], rows: int, distance: int = 3) -> list[tuple[int, int]]:
    """[(mask, threshold)] whose probes find every pair of fingerprints within distance, at the least estimated work.

    A pair within distance differs in at most t_i bits of some partition i whenever sum(t_i + 1) = distance + 1.
    Work: rows probed, and a fifth for each expected candidate pair.
    """
    bits = np.unpackbits(np.array(sample or [0], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    found: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for count in range((distance + 2) // 2, distance + 3):
        groups, costs = correlated_partitions(bits, count), []
        for g in groups:
            pairs = expected_collisions(bits, g, 1)
            probes = [1, 1 + bits[:, g].sum(1).mean()]  # a flip clears one set bit: one end of each pair at distance 1 has it
            costs.append([0.0, *(rows * probes[t] + 0.2 * pairs[t] * rows * rows / 2 for t in (0, 1))])
        cost, taken = allocate(costs, distance + 1)
        if cost < found[0]:
            found = (cost, [(sum(1 << b for b in g), t) for g, t in zip(groups, taken) if t >= 0])
    return found[1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def probes(fps: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """(part, key, fp): each partition's bits, and for threshold 1 also with one set bit cleared."""
    fp, parts = F.col("fp"), []
    for i, (mask, t) in enumerate(masks):
        key = fp.bitwiseAND(F.lit(signed(mask)))
        flips = [F.when(fp.bitwiseAND(F.lit(signed(1 << b))) != 0, F.struct(F.lit(i).alias("part"), key.bitwiseXOR(F.lit(signed(1 << b))).alias("key"))) for b in range(BITS) if t and mask >> b & 1]
        parts += [F.struct(F.lit(i).alias("part"), key.alias("key")), *flips]
    return fps.select("fp", F.explode(F.array(*parts)).alias("p")).where("p is not null").select("p.part", "p.key", "fp")


# ---- candidates: verified inside each bucket


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def links_of_bucket(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that join up every pair within distance in a bucket: a breadth-first search over those not yet reached."""
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = _near(rest, at, distance)
            if hit.any():
                for x in rest[hit]:
                    yield int(at), int(x)
                queue.extend(rest[hit])
                rest = rest[~hit]


def _small_buckets(of: np.ndarray, fps: np.ndarray, distance: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All links in buckets of up to most rows, by comparing rows 1, 2, ... places apart."""
    a, b = [], []
    for d in range(1, most):
        same = np.flatnonzero(of[d:] == of[:-d])
        if not len(same):
            break
        same = same[_near(fps[same], fps[same + d], distance) & (fps[same] != fps[same + d])]
        a.append(fps[same])
        b.append(fps[same + d])
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


OUT = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def search_buckets(distance: int, limit: int, last: bool):
    """For mapInArrow over (bucket, fp, used) sorted by bucket: links (kind 0: a, b), and the rows of buckets over limit (kind 1: key, a = fp, b = used bits)."""

    def emit(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(key), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=OUT)

    def whole(key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of complete buckets, none over limit unless last."""
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(edge, len(key)))
        few = np.repeat(size <= 24, size) & np.repeat(size > 1, size)
        a, b = _small_buckets(key[few], fps[few], distance, 24)
        if len(a):
            yield emit(0, np.zeros(len(a), np.int64), a, b)
        for i, n in zip(edge[size > 24], size[size > 24]):
            pairs = list(links_of_bucket(np.unique(fps[i : i + n]), distance))
            if pairs:
                found = np.array(pairs, np.uint64)
                yield emit(0, np.zeros(len(found), np.int64), found[:, 0].copy(), found[:, 1].copy())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, used, over = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64), None
        for part in parts:
            k, f, u = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            key, fps, used = np.concatenate((key, k)), np.concatenate((fps, f.view(np.uint64))), np.concatenate((used, u.view(np.uint64)))
            if not len(key):
                continue
            if over is not None:  # the bucket that ran over limit goes on
                n = int(np.searchsorted(key != over, True))
                yield emit(1, key[:n], fps[:n], used[:n])
                key, fps, used = key[n:], fps[n:], used[n:]
                if not len(key):
                    continue
                over = None
            cut_at = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
            done, key, at = key[:cut_at], key[cut_at:], cut_at
            ready, fps, spent, used = fps[:at], fps[at:], used[:at], used[at:]
            if len(done):
                yield from settle(done, ready, spent)
            if len(key) > limit and not last:
                over = key[0]
                yield emit(1, key, fps, used)
                key, fps, used = key[:0], fps[:0], used[:0]
        if len(key):
            yield from settle(key, fps, used)

    def settle(key: np.ndarray, fps: np.ndarray, used: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not last:
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(edge, len(key)))
            much = np.repeat(size > limit, size)
            if much.any():
                yield emit(1, key[much], fps[much], used[much])
                key, fps = key[~much], fps[~much]
        if len(key):
            yield from whole(key, fps)

    return run


def similar_links(fps: DataFrame, distance: int = 3, sample_rows: int = 4096, bucket_limit: int = 4096) -> DataFrame:
    """(a, b): links among distinct fingerprints fps(fp) that connect exactly what all pairs within distance connect.

    The plan is fitted on at most sample_rows fingerprints; every fingerprint is probed. A bucket is searched in
    one task up to bucket_limit rows; a larger one is dealt out again by the bits that its key leaves (four exact
    blocks, which by the pigeonhole principle hold every pair within 3), level by level.
    """
    rows = fps.count()
    sample = [r[0] & (1 << 64) - 1 for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()]
    masks = plan(sample, rows, distance)
    used = F.element_at(F.array(*[F.lit(signed(m)) for m, _ in masks]), F.col("part") + 1)
    level = probes(fps, masks).select(F.xxhash64("part", "key").alias("bucket"), "fp", used.alias("used"))
    links, kind = None, "kind int, key long, a long, b long"
    for depth in range(5):
        spread = level.repartition("bucket").sortWithinPartitions("bucket")
        found = cut(spread.mapInArrow(search_buckets(distance, bucket_limit, depth == 4), kind))
        here = found.where("kind = 0").select("a", "b")
        links = here if links is None else links.union(here)
        over = found.where("kind = 1")
        if depth == 4 or over.isEmpty():
            break
        blocks = F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda i: F.struct(i.alias("i"), _block(F.col("b"), i, distance + 1).alias("mask")))
        level = over.select("key", F.col("a").alias("fp"), "b", F.explode(blocks).alias("s")).select(
            F.xxhash64("key", "s.i", F.col("fp").bitwiseAND(F.col("s.mask"))).alias("bucket"), "fp", F.col("b").bitwiseOR(F.col("s.mask")).alias("used"))
    return links.distinct()


def _block(used: F.Column, i: F.Column, count: int) -> F.Column:
    """The i-th of count blocks of the bits that used leaves: those at positions i modulo count."""
    blocks = [F.lit(signed(sum(1 << b for b in range(BITS) if b % count == k))) for k in range(count)]
    return F.element_at(F.array(*blocks), i + 1).bitwiseAND(F.bitwise_not(used))


# ---- operator


def _components(prints: DataFrame, fps: DataFrame, width: int, distance: int, similarity: float | None) -> DataFrame:
    """(fp, component) of every linked fingerprint of fps(fp): component is the least fingerprint reachable.

    prints(row, __text, fp, s) are needed with `similarity` alone.
    """
    links = similar_links(fps.select("fp"), distance)
    if similarity is not None:  # equal fingerprints don't make equal sets: one node for each set, named by its least row, whose links are then its fingerprint's
        sketched = prints.where("s is not null")
        sets = sketched.groupBy("fp", "s.digest").agg(F.min(F.struct(F.col("row").alias("node"), "s.bands", "s.sketch")).alias("one"))
        nodes = cut(sets.select("fp", "one.*"))
        texts = sketched.select(F.col("row").alias("node"), F.col("__text").alias("text"), "s.sketch", "s.more")
        found = resemblance.similar_texts(nodes, similarity, texts=texts, hashes_of=lambda x: shingle_hashes(x, width))
        for end in ("a", "b"):
            found = found.join(nodes.select(F.col("node").alias(end), F.col("fp").alias(f"fp_{end}")), end)
        links = links.union(found.select("fp_a", "fp_b").where("fp_a <> fp_b").distinct())
    return connected_components(links).withColumnsRenamed({"node": "fp"})


def _printed(docs: DataFrame, text: str, keep: list[Column], width: int, similarity: float | None) -> DataFrame:
    """keep's columns with fp, and with `similarity` also row, __text and s, cut, so that row numbers stay."""
    more = [F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").alias("__text")] if similarity is not None else []
    names = [c for c in docs.select(*keep).columns] + ["row", "__text"] * bool(more)
    frame = docs.select(*keep, *more, *([] if more else [F.col(f"`{text}`").alias("__text")]))
    return cut(with_fingerprints(frame, "__text", names, width, similarity is not None))


def near_duplicates(docs: DataFrame, text: str = "text", id_: str = "doc_id", width: int = 3, distance: int = 3, similarity: float | None = None) -> DataFrame:
    """(id, fp, component): every row of docs with its fingerprint and its component, named by the smallest id in it.

    Fingerprints link when at most distance bits differ; empty and null texts have fingerprint 0 and link like any
    other. Equal fingerprints count once in the search, so groups of exact copies cost one probe. With `similarity`,
    texts whose sets of shingles are that similar link, too; equal sets count once there. Rows with a null id stay; a
    component of such rows alone has a null name. Repeated rows stay repeated. Other columns are ignored.
    """
    with scope() as made:
        prints = _printed(docs, text, [F.col(id_).alias("__id")], width, similarity)
        fps = cut(prints.groupBy("fp").agg(F.min("__id").alias("least")))
        linked = _components(prints, fps, width, distance, similarity).join(fps, "fp")
        names = linked.groupBy("component").agg(F.min("least").alias("name"))
        named = linked.join(names, "component").select("fp", "name")
        alone = fps.join(named.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("name"))
        named = cut(named.unionByName(alone))
    release(docs.sparkSession, made, prints, named)
    return prints.select("__id", "fp").join(named, "fp").select(F.col("__id").alias(id_), "fp", F.col("name").alias("component"))


def _row_key(docs: DataFrame, id_: str) -> tuple[Column, Column]:
    """What tells rows apart: the id and 128 bits of the whole row, apart from maps."""
    whole = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    nulls = F.concat_ws("", *[F.isnull(c).cast("string") for c in whole])  # a null leaves the hash as it was
    return F.col(f"`{id_}`").alias("__id"), F.struct(F.xxhash64(F.lit(1), nulls, *whole).alias("a"), F.xxhash64(F.lit(2), nulls, *reversed(whole)).alias("b")).alias("__key")


def representatives(docs: DataFrame, text: str = "text", id_: str = "doc_id", width: int = 5, distance: int = 3, similarity: float | None = 0.8) -> DataFrame:
    """The rows of docs without their near copies: of each group of linked texts one row stays, one with the group's smallest id.

    Rows are told apart by their content, not by their id: a row goes only if its text links to that of a row that
    stays, so different texts under one id (or under none) all stay. Null ids come last. Of several rows with the
    smallest id the one with the least hash of all its columns stays; of equal rows one. Empty and null texts are one
    group. An empty table gives no rows. Columns and their order are kept.
    """
    names = docs.columns
    with scope() as made:
        prints = _printed(docs, text, list(_row_key(docs, id_)), width, similarity)
        rows = cut(prints.groupBy("fp", "__id", "__key").agg(F.count("*").alias("n")))
        best = F.min(F.struct(F.col("__id").isNull().alias("last"), F.col("__id").alias("id"), F.col("__key").alias("key")))
        fps = cut(rows.groupBy("fp").agg(best.alias("best")))
        linked = _components(prints, fps, width, distance, similarity).join(fps, "fp")
        chosen = linked.groupBy("component").agg(F.min("best").alias("best"))
        named = linked.select("fp", "component").join(chosen, "component").select("fp", "best")
        alone = fps.join(named.select("fp"), "fp", "left_anti").select("fp", "best")
        stays = F.col("__id").eqNullSafe(F.col("best.id")) & (F.col("__key") == F.col("best.key"))
        judged = cut(rows.join(cut(named.unionByName(alone)), "fp").select("__key", "n", stays.alias("stays")))
    release(docs.sparkSession, made, judged)
    gone = judged.where("not stays").select(F.col("__key").alias("__gone")).distinct()
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)), _row_key(docs, id_)[1])
    kept = keyed.join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    twice = judged.where("stays and n > 1").select(F.col("__key").alias("__twice"))
    if not twice.isEmpty():
        hot = kept.join(twice, F.col("__key") == F.col("__twice"), "left_semi")
        kept = kept.join(twice, F.col("__key") == F.col("__twice"), "left_anti").unionByName(hot.dropDuplicates(["__key"]))
    return kept.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(names)))
