"""Mixing sources to target weights by entropy balancing over documents."""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, drop_cut, release, scope

WORDS = r"[^\x20\x09-\x0D]+"
MOST = 3  # times its size that a document or source may come to
BINS = 512  # a unit of the places that copies have in their size class
CHUNK = 1 << 16  # equal rows are repeated by so many at a time
SUM = "decimal(38,12)"  # sums of which don't depend on the order of rows, so that reruns agree
STEEPEST = -60.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources(source, words) with weight and target.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the sum of all words; a target stops
    at MOST times its source's words and the excess goes to the others by weight, until none is above. Each round is
    one aggregate over the sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    ranked = cut(sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1))
    total = ranked.agg(F.coalesce(F.sum("words"), F.lit(0)).cast("double")).first()[0]
    level = 0.0
    while True:
        over = F.col("weight") * level >= MOST * F.col("words")
        capped, open_ = ranked.agg(F.sum(F.when(over, MOST * F.col("words"))).cast("double"), F.sum(F.when(~over, F.col("weight"))).cast("double")).first()
        if not open_ or (total - (capped or 0.0)) / open_ <= level:
            break
        level = (total - (capped or 0.0)) / open_
    return ranked.withColumn("target", F.least(F.col("weight") * level, (MOST * F.col("words")).cast("double")))


def rate(multiplier: Column, size: Column) -> Column:
    """The weight that the balance gives a document: its base weight of one, tilted exponentially by its size, at most MOST."""
    return F.least(F.lit(float(MOST)), F.exp(F.least(multiplier * size, F.lit(log(MOST) + 1))))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _newton_step(state: DataFrame, sizes: DataFrame) -> DataFrame:
    """One Newton step of every source's multiplier: the dual's gradient and curvature are summed over all documents.

    The step is taken on the logarithms of sum(size * rate) and target, between which the relation is almost straight;
    it stays inside the bracket (low, high) that the signs of the gradients so far leave, and halves it else.
    """
    names = ["source", "words", "target", "multiplier", "low", "high", "apart"]
    at = state.select(F.col("source").alias("__s"), *(c for c in names if c != "source"))
    w, x = rate(F.col("multiplier"), F.col("size")), F.col("size").cast("double")
    got = F.sum((F.col("n") * x * w).cast(SUM)).cast("double")
    bend = F.sum(F.when(w < MOST, F.col("n") * x * x * w).cast(SUM)).cast("double")
    summed = sizes.join(at, _same("source", "__s")).groupBy(*names).agg(got.alias("got"), bend.alias("bend"))
    gap = F.log(F.greatest(F.col("got"), F.lit(1e-12))) - F.log(F.col("target"))
    solved = (F.col("target") >= MOST * F.col("words")) | (F.abs(gap) <= 1e-9)
    low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
    high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
    step = F.col("multiplier") - gap * F.col("got") / F.nullif(F.col("bend"), F.lit(0.0))
    inside = step.isNotNull() & (step > low) & (step < high)
    then = F.when(solved, F.col("multiplier")).when(inside, step).otherwise((low + high) / 2)
    return summed.select("source", "words", "target", then.alias("multiplier"), low.alias("low"), high.alias("high"), F.when(solved, F.lit(0.0)).otherwise(F.abs(gap)).alias("apart"))


def multipliers(sources: DataFrame, sizes: DataFrame, steps: int = 80, at_once: int = 4) -> DataFrame:
    """sources(source, words, target) with multiplier, from sizes(source, size, n), the exact counts of documents by size.

    Entropy balancing: of all document rates with sum(size * rate) = target in every source, those nearest in entropy
    to the base weights of one, capped at MOST. The convex dual has one multiplier a source, whose
    rates are exp(multiplier * size). Its gradient and curvature are aggregates over the documents; a job makes
    at_once steps for all sources together, until sums and targets agree to 1e-9. A source without words, or of
    which all is taken MOST times, needs no step. RuntimeError if `steps` steps leave over 1e-6.
    """
    trivial = F.when(F.col("target") >= MOST * F.col("words"), F.lit(log(MOST))).otherwise(F.lit(0.0))
    state = cut(sources.where("words > 0 and target > 0").select("source", "words", "target", trivial.alias("multiplier"), F.lit(STEEPEST).alias("low"), F.lit(log(MOST)).alias("high"), F.lit(1.0).alias("apart")))
    for _ in range(0, steps, at_once):
        step = state
        for _ in range(at_once):
            step = _newton_step(step, sizes)
        step = cut(step)
        drop_cut(state)
        state = step
        apart = state.agg(F.max("apart")).first()[0] or 0.0
        if apart == 0:
            break
    if apart > 1e-6:
        raise RuntimeError("entropy balancing didn't converge")
    solved = state.select(F.col("source").alias("__s"), "multiplier")
    return sources.join(solved, _same("source", "__s"), "left").drop("__s").withColumn("multiplier", F.coalesce("multiplier", F.lit(0.0)))


def _chance(key: Column, j: Column, m: Column) -> Column:
    """A number in [0, 1) for the j-th of m equal rows; they lie evenly spaced behind a hash of the row."""
    first = F.shiftrightunsigned(F.xxhash64(key), 12).cast("double") / float(1 << 52)
    return F.pmod(first + j / m, F.lit(1.0))


def _places(multiplier: Column, size: Column, chance: Column) -> Column:
    """For each of MOST copies of a document, the bin of its place: chance + j - rate for the j-th.

    Places under 0 are as many as the rate on average, and differ from it by less than one.
    """
    place = lambda j: chance + j - rate(multiplier, size)
    return F.array(*[F.least(F.lit(2 * MOST * BINS - 1), F.greatest(F.lit(0), F.floor((place(j) + MOST) * BINS))).cast("int") for j in range(MOST)])


def _each(rows: DataFrame, n: Column) -> DataFrame:
    """rows, each n times, with j from 0; a row's repeats are made by CHUNK at a time, whatever their number."""
    some = rows.withColumn("__n", n.cast("long")).where("__n > 0")
    part = some.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / CHUNK))))
    end = F.least(F.col("__n") - 1, F.col("__c") * CHUNK + CHUNK - 1)
    return part.withColumn("j", F.explode(F.sequence(F.col("__c") * CHUNK, end))).drop("__n", "__c")


def size_class(size: Column) -> Column:
    """0 for the longest; sizes of a class differ by less than a factor of two."""
    return F.when(size > 0, 62 - F.floor(F.log2(size.cast("double"))).cast("int")).otherwise(F.lit(63))


def _limits(group: pd.DataFrame) -> pd.DataFrame:
    """Of one source: for each size class, longest first, the bin below which copies are taken; what is missed passes on to the class of shorter ones.

    While over a thousandth of all is missed at the end, the two classes whose other limits leave the least change to these.
    """
    classes, sums, bins, at, missed = [], [], [], [], 0.0
    for size_class, part in group.sort_values(["size_class", "bin"]).groupby("size_class", sort=False):
        wish = missed + float(part["wish"].sum())
        classes.append(size_class)
        sums.append(np.concatenate(([0.0], part["words"].cumsum())))
        bins.append([0, *(part["bin"] + 1)])
        at.append(int(np.abs(sums[-1] - wish).argmin()))
        missed = wish - float(sums[-1][at[-1]])
    while abs(missed) > group["wish"].sum() / 1000:
        best = (abs(missed), 0, at[0], 0, at[0])
        for i, x in enumerate(sums):
            left = missed - (x - x[at[i]])  # of every limit of the one
            for j, y in enumerate(sums):
                if i != j:
                    to = np.searchsorted(y, y[at[j]] + left).clip(1, len(y) - 1)
                    to -= np.abs(y[to - 1] - y[at[j]] - left) <= np.abs(y[to] - y[at[j]] - left)
                    then = np.abs(left - (y[to] - y[at[j]]))
                    if then.min() < best[0]:
                        k = int(then.argmin())
                        best = (float(then[k]), i, k, j, int(to[k]))
        if best[0] >= abs(missed):
            break
        for c, k in (best[1:3], best[3:5]):
            missed -= float(sums[c][k] - sums[c][at[c]])
            at[c] = k
    return pd.DataFrame({"source": [group["source"].iloc[0]] * len(at), "size_class": classes, "limit": [int(b[i]) for b, i in zip(bins, at)]})


def thresholds(rows: DataFrame) -> DataFrame:
    """(source, size_class, limit) from rows(source, size, multiplier, places): copies whose place lies under the limit are taken.

    A class takes the words that its rates ask for, and what longer classes have missed, as near as whole bins allow; so a source misses its
    target by about half of a bin of its shortest documents, or by less. A task reads at most 64 classes of 2 * MOST * BINS sums of a source, whatever its rows.
    """
    words = rows.where("size > 0").select("source", "size", size_class(F.col("size")).alias("size_class"), (F.col("size") * rate(F.col("multiplier"), F.col("size"))).cast(SUM).alias("wish"), F.posexplode("places").alias("j", "bin"))
    cells = words.groupBy("source", "size_class", "bin").agg(F.sum("size").cast("double").alias("words"), F.sum(F.when(F.col("j") == 0, F.col("wish"))).cast("double").alias("wish"))
    return cells.groupBy("source").applyInPandas(_limits, "source string, size_class int, limit int")


def balance(kinds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kinds' rows with places; sources with words, target and multiplier; limits) for kinds(source, size, key, m): m rows that are equal."""
    with scope() as made:
        sizes = cut(kinds.groupBy("source", "size").agg(F.sum("m").alias("n")))
        sources = cut(multipliers(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))), sizes))
        rows = _placed(_each(kinds, F.col("m")), sources, _chance(F.col("key"), F.col("j"), F.col("m")))
        limits = cut(thresholds(rows))
    release(kinds.sparkSession, made, sources, limits)
    return rows, sources, limits


def _placed(rows: DataFrame, sources: DataFrame, chance: Column) -> DataFrame:
    """rows(source, size) with their source's size and target, and places. One row a source; the join broadcasts them only while they are small."""
    of = sources.select(F.col("source").alias("__s"), F.col("words").alias("source_size"), "target", "multiplier")
    return rows.join(of, _same("source", "__s")).drop("__s").withColumn("places", _places(F.col("multiplier"), F.col("size"), chance))


def _copies(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows(source, size, places) with copies; texts of size 0 stay once. limits has at most 64 rows a source; the join broadcasts them only while they are small."""
    at = limits.select(F.col("source").alias("__t"), F.col("size_class").alias("__c"), "limit")
    joined = rows.join(at, _same("source", "__t") & (size_class(F.col("size")) == F.col("__c")), "left")
    taken = F.size(F.filter("places", lambda x: x < F.col("limit")))
    return joined.withColumn("copies", F.when(F.col("limit").isNull(), F.lit(1)).otherwise(taken)).drop("__t", "__c", "limit")


def _content(docs: DataFrame) -> Column:
    """128 bits of a whole row but its maps: rows share copies only if they are equal."""
    whole = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    nulls = F.concat_ws("", *[F.isnull(c).cast("string") for c in whole])  # a null leaves the hash as it was
    return F.struct(F.xxhash64(nulls, *whole).alias("a"), F.xxhash64(F.lit(1), nulls, *reversed(whole)).alias("b"))


def mix(docs: DataFrame, text: str = "text", id_: str = "doc_id", source: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row of docs.

    Null and empty texts have size 0 and take nothing. Null sources are one source, ranked last. Who gets a copy more
    is decided by a hash of id, source and text; of equal rows as many as their rate asks for, so null and repeated
    ids meet their target, too. Results don't depend on order or partitions. An empty table gives no rows.
    """
    own = docs.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    sized = own.select("id", "source", word_count(F.col("text")).alias("size"), _content(own).alias("key"))
    kinds = cut(sized.groupBy("source", "size", "key", "id").agg(F.count("*").alias("m")))
    rows, _, limits = balance(kinds)
    return _copies(rows, limits).select(
        F.col("id").alias(id_), "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def resample(docs: DataFrame, text: str = "text", id_: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with every row repeated as often as the mix takes it; rows that it takes no copy of go.

    Texts are not shuffled, but those of rows that are equal in all columns, of which one is repeated for all. A text of size
    0 has a rate of one and stays once. Columns and their order are kept. An empty table gives no rows.
    """
    names = docs.columns
    sized = docs.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)), F.col(f"`{source}`").alias("source"),
                        word_count(F.col(f"`{text}`")).alias("size"), _content(docs).alias("key"))
    kinds = cut(sized.groupBy("source", "size", "key").agg(F.count("*").alias("m")))
    rows, sources, limits = balance(kinds)
    own = [F.col(f"__{i}").alias(c) for i, c in enumerate(names)]
    repeated = kinds.where("m > 1").select(F.col("key").alias("__key"))
    many = not repeated.isEmpty()
    single = sized.join(repeated, F.col("key") == F.col("__key"), "left_anti") if many else sized
    single = _placed(single, sources, _chance(F.col("key"), F.lit(0), F.lit(1)))
    out = _each(_copies(single, limits), F.col("copies")).select(*own)
    if many:
        taken = _copies(rows.where("m > 1"), limits).groupBy("key").agg(F.sum("copies").alias("copies")).withColumnRenamed("key", "__key")
        firsts = sized.join(repeated, F.col("key") == F.col("__key"), "left_semi").dropDuplicates(["key"])
        out = out.unionByName(_each(firsts.join(taken, F.col("key") == F.col("__key")), F.col("copies")).select(*own))
    return out
