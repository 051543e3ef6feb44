"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import erfc, exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut, tune

WORD = re.compile(r"[^\W\d_]+")
STEMS = (7, 6, 5, 4, 3)  # leading letters that a word shares with its kin
STEM_MARK = "^"
KEPT_WORDS = 200_000


@dataclass
class Model:
    """Token scores, and what turns segment scores into a probability."""

    words: dict[str, float] = field(default_factory=dict)  #: log-odds of words that differ significantly
    stems: dict[str, float] = field(default_factory=dict)  #: for words that have none of their own
    drift: float = 0.25  #: taken from every token, so that ordinary text scores below zero on average
    decay: float = 1.0  #: lambda of the extreme-value law
    scale: float = 1.0  #: K of the extreme-value law
    logit: tuple[float, float] = (-40.0, 0.0)  #: intercept and slope over -ln(E-value)


class _Scores(dict):
    """word -> score; a word without its own takes that of its longest stem that has one. Keeps `kept` words beyond those with scores."""

    def __init__(self, model: Model, kept: int = KEPT_WORDS):
        self.words, self.stems, self.drift = model.words, model.stems, model.drift
        self.most = kept + len(model.words)
        self._begin()

    def _begin(self) -> None:
        self.clear()
        self.update({w: s - self.drift for w, s in self.words.items()})

    def __missing__(self, word: str) -> float:
        if len(self) > self.most:
            self._begin()
        found = next((self.stems[word[:n]] for n in STEMS if word[:n] in self.stems), 0.0)
        self[word] = found - self.drift
        return self[word]

    def of(self, words: list[str]) -> list[float]:
        """A score for each token; a word that occurs again counts half as much each time, for it was learnt by documents."""
        got = [self[w] for w in words]
        seen: Counter = Counter()
        for i, x in enumerate(got):
            if x > 0:
                if n := seen[words[i]]:
                    got[i] = (x + self.drift) * 0.5 ** min(n, 60) - self.drift
                seen[words[i]] += 1
        return got


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time (Ruzzo and Tompa)."""
    found: list[list] = []  # [start, end, sum before, sum through, index of the last before it with a lower left sum]
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        at = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= at[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= at[3]:
                found.append([*at, j])
                break
            at = [found[j][0], at[1], found[j][2], at[3]]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """maximal_segments, with the runs between positive scores taken together: segments start and end at positive scores."""
    hot = [i for i, s in enumerate(scores) if s > 0]
    if not hot:
        return []
    packed, places, last = [], [], hot[0]
    for i in hot:
        if i > last:
            packed.append(sum(scores[last:i]))
            places.append(last)
        packed.append(scores[i])
        places.append(i)
        last = i + 1
    return [(places[a], places[b - 1] + 1, s) for a, b, s in maximal_segments(packed)]


def evidence(found: list[tuple[int, int, float]], tokens: int, model: Model) -> float:
    """-ln of the E-value of the document's segments taken together: the best one's, and what others significant by themselves add.

    0 to 200: a text whose segments chance alone explains has no evidence, whatever its length.
    """
    base = -log(model.scale * max(tokens, 1))
    return min(200.0, sum(max(0.0, base + model.decay * s) for _, _, s in found))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 30_000, prior: float = 5.0, false_share: float = 0.05) -> Model:
    """Fit on at most train_rows labelled documents (those with the least hash of their id).

    docs(doc_id, text), labels(doc_id, toxic). A document labelled more than once counts as toxic if any label says
    so; null ids and null labels are left out. Counts are of documents that hold a word; near copies in the sample
    share one document's weight. A word's Dirichlet prior is its stem's rate, a stem's the rate of all documents. Words
    and stems score only if their log-odds are so far from zero that at most `false_share` of those kept are expected
    to be there by chance (false discovery rate over all keys that occur often enough to be tested). What turns
    segments into a probability is learnt by cross-fitting: each document is judged by a model of the other folds.
    """
    tune(docs.sparkSession)
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # bounded, so it can be broadcast
    train = cut(_sketched(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")))
    kin = _kin(train)
    counts = cut(_key_counts(train, kin))
    all_ = counts.where("key = ''").first()
    if not all_:
        return Model()
    sums = Sums(np.array(all_["t"]), np.array(all_["c"]))
    t, c = (F.aggregate(x, F.lit(0.0), lambda a, b: a + b) for x in ("t", "c"))
    keys = counts.where("key <> ''").withColumn("n", F.round(F.least(t + c, F.lit(100.0)) * 2) / 2)
    often = {r["n"]: r["count"] for r in keys.groupBy("n").count().collect()}  # at most 200 rows
    rate = sums.rate()
    likely = F.log((t + prior * rate) / (c + prior * (1 - rate))) - log(rate / (1 - rate))
    sure = F.sqrt(1 / (t + prior * rate) + 1 / (c + prior * (1 - rate)))
    # Keys that can't be significant stay on the executors.
    kept = keys.where(F.abs(likely) > LEAST_SIGMA * sure).collect()  # bounded by the sample
    drop_cut(counts)
    table = {r["key"]: (np.array(r["t"]), np.array(r["c"])) for r in kept}
    sigma = _gate([_odds(t.sum(), c.sum(), rate, rate, prior) for t, c in table.values()], often, rate, prior, false_share)
    model = _weigh(table, sums, sigma, prior)
    _calibrate(train, kin, [_weigh(table, sums, sigma, prior, without=k) for k in range(FOLDS)], model)
    drop_cut(train)
    return model


#: Documents of one fold are judged by a model of the others. Minima of a document's word pairs tell its near copies.
FOLDS, MINIMA = 5, 9
#: Standard deviations that a key needs at the very least, however few keys there are.
LEAST_SIGMA = 2.5
_MIX = np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 63, MINIMA, np.uint64) | np.uint64(1)


@dataclass
class Sums:
    """Weights of the toxic and clean documents of each fold."""

    toxic: np.ndarray
    clean: np.ndarray

    def rate(self, without: int | None = None) -> float:
        t, c = (float(x.sum() - (0 if without is None else x[without])) for x in (self.toxic, self.clean))
        return (t + 0.5) / (t + c + 1)


def minima(words: list[str]) -> list[int]:
    """The least value of a text's set of word pairs under each of MINIMA functions; texts without a pair have their words instead."""
    if not words:
        return [0] * MINIMA
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    one = np.fromiter((known[w] for w in words), np.uint64, len(words))
    pairs = np.unique(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + (one[1:] ^ one[1:] >> np.uint64(29)) if len(one) > 1 else one)
    return [int((x ^ x >> np.uint64(32)).min() >> np.uint64(1)) for x in (pairs * m for m in _MIX)]


def _sketched(rows: DataFrame) -> DataFrame:
    """rows(toxic, text) with the text's minima."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [minima(WORD.findall((x.as_py() or "").lower())) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "text", "minima"])

    return rows.mapInArrow(run, "toxic int, text string, minima array<long>")


def _kin(train: DataFrame) -> dict[tuple[int, int], int]:
    """How many documents share a minimum, where several do; bounded by the sample."""
    shared = train.select(F.posexplode("minima").alias("j", "m")).groupBy("j", "m").count().where("count > 1")
    return {(r["j"], r["m"]): r["count"] for r in shared.collect()}


def _weight(least: list[int], kin: dict[tuple[int, int], int]) -> float:
    """A document's share: one over the number of those that have most of its minima, itself included."""
    return 1 / sorted(kin.get((j, m), 1) for j, m in enumerate(least))[MINIMA // 2]


def _fold(least: list[int]) -> int:
    """Near copies mostly have the same."""
    return (least[0] >> 7) % FOLDS


def _key_counts(train: DataFrame, kin: dict) -> DataFrame:
    """(key, t, c): the weights of toxic and of clean documents with each word and stem, by fold; the key '' has all documents."""
    shared = train.sparkSession.sparkContext.broadcast(kin)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            index: dict[str, int] = {}
            places, weights = array("q"), array("d")
            for toxic, text, least in zip(*(part.column(i).to_pylist() for i in range(3))):
                at, weight = (0 if toxic > 0 else FOLDS) + _fold(least), _weight(least, shared.value)
                words = set(WORD.findall((text or "").lower()))
                keys = ["", *words, *{STEM_MARK + w[:n] for w in words for n in STEMS if len(w) >= n}]
                places.extend([2 * FOLDS * index.setdefault(k, len(index)) + at for k in keys])
                weights.extend([weight] * len(keys))
            if index:
                every = np.bincount(np.frombuffer(places, np.int64), np.frombuffer(weights), 2 * FOLDS * len(index)).reshape(-1, 2 * FOLDS)
                ends = pa.array(np.arange(0, FOLDS * len(every) + 1, FOLDS), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(index), pa.string()), *(pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (every[:, :FOLDS], every[:, FOLDS:]))], names=["key", "t", "c"])

    found = train.mapInArrow(count, "key string, t array<double>, c array<double>")
    total = lambda x: F.array(*[F.sum(F.col(x)[k]) for k in range(FOLDS)]).alias(x)
    return found.groupBy("key").agg(total("t"), total("c"))


def _odds(t: float, c: float, p: float, rate: float, prior: float) -> tuple[float, float]:
    """Log-odds against the rate of all documents under a Dirichlet prior of rate p, and their standard deviation."""
    return log((t + prior * p) / (c + prior * (1 - p))) - log(rate / (1 - rate)), (1 / (t + prior * p) + 1 / (c + prior * (1 - p))) ** 0.5


def _gate(odds: list[tuple[float, float]], often: dict[float, int], rate: float, prior: float, false_share: float) -> float:
    """The least number of standard deviations at which chance gives at most false_share of the keys beyond it.

    Chance is counted over the keys that are frequent enough to come so far at all; often: keys by frequency.
    """
    found = np.sort(np.array([abs(s) / e for s, e in odds]))
    best = {n: max(abs(s) / e for s, e in (_odds(n, 0, rate, rate, prior), _odds(0, n, rate, rate, prior))) for n in often}
    for sigma in np.arange(LEAST_SIGMA, 8, 0.1):
        tested = sum(count for n, count in often.items() if best[n] >= sigma)
        if tested * erfc(sigma / 2**0.5) <= false_share * (len(found) - np.searchsorted(found, sigma)):
            return float(sigma)
    return 8.0


def _weigh(table: dict[str, tuple[np.ndarray, np.ndarray]], sums: Sums, sigma: float, prior: float, without: int | None = None) -> Model:
    """The model of all folds, or of all but one."""
    rate, model = sums.rate(without), Model()
    of = {k: tuple(max(0.0, float(x.sum() - (0 if without is None else x[without]))) for x in both) for k, both in table.items()}
    for key, (t, c) in of.items():
        if key[0] == STEM_MARK:
            score, error = _odds(t, c, rate, rate, prior)
            if abs(score) > sigma * error:
                model.stems[key[1:]] = score
    for key, (t, c) in of.items():
        if key[0] != STEM_MARK:
            st, sc = next((of[STEM_MARK + key[:n]] for n in STEMS if key[:n] in model.stems), (0, 0))
            score, error = _odds(t, c, (st + prior * rate) / (st + sc + prior), rate, prior)
            if abs(score) > sigma * error:
                model.words[key] = score
    return model


def _calibrate(train: DataFrame, kin: dict, others: list[Model], model: Model) -> Model:
    """lambda and K from clean documents, then the logistic curve over -ln(E-value), from sums over the sample; others[k] is fitted without fold k."""
    shared = train.sparkSession.sparkContext.broadcast((others, kin))

    def judged(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, float, list[float]]]:
        """(toxic, weight, token scores) of each document."""
        models, kin = shared.value
        score = [_Scores(m, KEPT_WORDS // len(models)) for m in models]
        for part in parts:
            for toxic, text, least in zip(*(part.column(i).to_pylist() for i in range(3))):
                yield toxic, _weight(least, kin), score[_fold(least)].of(WORD.findall((text or "").lower()))

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for toxic, weight, got in judged(parts):
            if toxic <= 0:
                for x, n in Counter(round(x * 4) / 4 for x in got).items():
                    seen["score", x] += weight * n
                best = max((s for _, _, s in segments(got)), default=0.0)
                if best > 0:
                    seen["best", 0.0] += weight * best
                    seen["size", 0.0] += weight * log(len(got))
                    seen["texts", 0.0] += weight
        yield _counted(seen)

    sums = {(r["kind"], r["x"]): r["n"] for r in train.mapInArrow(tally, COUNTED).groupBy("kind", "x").agg(F.sum("n").alias("n")).collect()}
    best = {kind: sums.get((kind, 0.0), 0.0) for kind in ("best", "size", "texts")}
    # Unseen positive scores get the weight of one token, so that lambda is finite.
    chance = {x: n for (kind, x), n in sums.items() if kind == "score"}
    top = max([1.0, *model.words.values(), *model.stems.values()]) - model.drift
    chance[top] = chance.get(top, 0.0) + 1.0
    total, low, high = sum(chance.values()), 0.01, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        if sum(n * exp(min(700.0, mid * x)) for x, n in chance.items()) > total:
            high = mid
        else:
            low = mid
    model.decay = (low + high) / 2
    if best["texts"]:  # the mean of a Gumbel variable is its mode and Euler's constant
        model.scale = exp(min(5.0, max(-15.0, (model.decay * best["best"] - best["size"]) / best["texts"] - 0.5772)))

    def curve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for toxic, weight, got in judged(parts):
            seen["clean" if toxic <= 0 else "toxic", float(round(evidence(segments(got), len(got), model) * 2) / 2)] += weight
        yield _counted(seen)

    bins = train.mapInArrow(curve, COUNTED).groupBy("kind", "x").agg(F.sum("n").alias("n")).collect()
    model.logit = _logistic(np.array([r["x"] for r in bins]), np.array([float(r["kind"] == "toxic") for r in bins]), np.array([r["n"] for r in bins], float))
    return model


#: What a pass over the sample adds up.
COUNTED = "kind string, x double, n double"


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([float(x) for _, x in seen], pa.float64()), pa.array(map(float, seen.values()), pa.float64())], names=["kind", "x", "n"])


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression with a weak ridge by damped Newton steps: a step is halved until the objective falls.

    One class alone gives its smoothed rate. Where more evidence goes with fewer toxic documents, the best slope that
    isn't negative is 0, with the smoothed rate.
    """
    rate = (float((n * y).sum()) + 0.5) / (float(n.sum()) + 1)
    a = np.array([log(rate / (1 - rate)), 0.0])
    if not 0 < (n * y).sum() < n.sum():
        return float(a[0]), 0.0
    design, ridge = np.stack([np.ones_like(x), x], 1), np.diag([1e-3, 1e-1])
    loss = lambda a: float((n * (np.logaddexp(0, design @ a) - y * (design @ a))).sum() + a @ ridge @ a / 2)
    now = loss(a)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -500, 500)))
        down = design.T @ (n * (y - p)) - ridge @ a
        if np.abs(down).max() <= 1e-7 * (1 + n.sum()):
            break
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + ridge, down)
        while (then := loss(a + step)) > now - 1e-4 * float(step @ down) and np.abs(step).max() > 1e-12:
            step = step / 2
        a, now = a + step, min(now, then)
    else:
        raise ArithmeticError("the logistic curve didn't converge")
    return (float(a[0]), float(a[1])) if a[1] > 0 else (log(rate / (1 - rate)), 0.0)


PASSAGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1) and toxic_passages: spans of code points of the lower-cased text with score and E-value.

    Every maximal segment whose E-value is under 1 is a passage. Null and empty texts have no passage and the score
    that the model gives to a text without toxic tokens. Rows are scored one by one in place: repeated rows repeat,
    no row moves. Columns of docs with these two names are replaced.
    """
    tune(docs.sparkSession)
    frame = docs.drop("toxicity", "toxic_passages")
    at, names = frame.columns.index(text), frame.columns
    schema = T.StructType([*frame.schema, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_passages", PASSAGE)])
    shared = frame.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        of, (a, b) = _Scores(model), model.logit
        for part in parts:
            scores, passages = [], []
            for value in part.column(at):
                low = (value.as_py() or "").lower()
                got = of.of(WORD.findall(low))
                found = segments(got)
                x = evidence(found, len(got), model)
                scores.append(1 / (1 + exp(-max(-700.0, min(700.0, a + b * x)))))
                base, spans = log(model.scale * max(len(got), 1)), []
                sure = [s for s in found if base < model.decay * s[2]]
                if sure:
                    places = [m.span() for m in WORD.finditer(low)]
                    spans = [{"start": places[i][0], "end": places[j - 1][1], "score": s, "e_value": exp(base - model.decay * s)} for i, j, s in sure]
                passages.append(spans)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(passages, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])))], names=[*names, "toxicity", "toxic_passages"])

    return frame.mapInArrow(run, schema)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that no label may be learnt from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """fit() on the rows outside the held-out fifth."""
    return fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
