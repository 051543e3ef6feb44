"""The llm operators and queries against brute force, round trips and held-out labels, and on odd tables."""

import hashlib
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import rows_of, rows_of_sql, tables
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import chat, components, hnsw, html_extract, kdtree, licenses, mixing, packing, queries, resemblance, sharding, simhash, toxicity, vectors
from ledgerloom.llm.vectors import unpack_arrays

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, shard int, fp long, toxicity double"
LONG = "word " * 60_000 + "idiot"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    """Null columns, empty, short and very long texts, repeated rows and ids, and columns named like those that operators make."""
    rows = [(1, None, None, None), (2, "", "en", "b"), (3, "a", "en", "b"), (3, "a", "en", "b"), (4, LONG, "en", "a"), (5, LONG, "en", None), (None, "some words here", "en", "a"), (6, "some words here", None, "a"), (7, " \n\t ", "en", "b"), (8, "Ünï cödé \u4e2d\u6587 ’ text", "de", "a")]
    return spark.createDataFrame([(*r, 0, 9, 9, 9, 9, 9.0) for r in rows], ODD)


def sf_dir(tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    found = rows_of(queries.QUERIES[name](spark, SF))
    assert found[1] and found == rows_of_sql(tables(SF), queries.ORACLE_SQL[name])


# ---- 1 toxicity


def slow_segments(scores):
    """Maximal segments by their definition: the best-scoring run, then those on either side of it."""
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    _, _, a, b = best
    return [*slow_segments(scores[:a]), (a, b), *[(x + b, y + b) for x, y in slow_segments(scores[b:])]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-40, 40).map(lambda x: x + 0.5 * (x % 7) + 0.013 * x * x), max_size=14))
def test_maximal_segments_follow_their_definition(scores):
    found = toxicity.maximal_segments(scores)
    assert sorted(round(s, 6) for _, _, s in found) == sorted(round(sum(scores[a:b]), 6) for a, b in slow_segments(scores))
    assert [round(x[2], 6) for x in toxicity.segments(scores)] == [round(x[2], 6) for x in found]


def test_toxicity_learns_from_its_fold_alone_and_holds_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all() and len(got) == 10_000
    held = got.merge(labels, on="doc_id").query("held_out")
    assert held[held.toxic == 1].predicted.mean() >= 0.85 and held[held.toxic == 0].predicted.mean() <= 0.02
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.5


@pytest.mark.parametrize("copies, edits", [(10, 0), (4, 0.05)])
def test_toxicity_is_learnt_as_well_from_labels_with_copies(spark, copies, edits):
    sf, held = "/root/testdata/sf0.1", toxicity.held_out(F.col("doc_id"))
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))

    def copied(parts):
        for part in parts:
            rows = []
            for i, text in zip(part.doc_id, part.text):
                rng = np.random.default_rng(i)
                for k in range(copies):
                    words = text.split(" ")
                    for at in rng.integers(0, len(words), int(edits * len(words)) if k else 0):
                        words[at] = f"{words[at]}q"
                    rows.append((100 * i + k, " ".join(words)))
            yield pd.DataFrame(rows, columns=["doc_id", "text"])

    more = docs.join(labels, "doc_id").where(~held).select("doc_id", "text").mapInPandas(copied, "doc_id long, text string")
    same = labels.where(~held).select(F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("k"), "doc_id", "toxic").select((100 * F.col("doc_id") + F.col("k")).alias("doc_id"), "toxic")
    model = toxicity.fit(more, same)
    got = toxicity.score(docs.where(held).select("doc_id", "text"), model).join(labels, "doc_id").select("toxic", "toxicity").toPandas()
    assert (got.toxicity[got.toxic == 1] >= 0.5).mean() >= 0.85 and (got.toxicity[got.toxic == 0] >= 0.5).mean() <= 0.02


def test_scores_against_brute_force(spark):
    """Token scores, segments by their definition and the probability, worked out naively for every short text of a table."""
    import math
    import re

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit_on_labels(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.words and model.stems and model.logit[1] > 0
    insults = sorted(model.words)[:3]
    more = spark.createDataFrame([(-i, f"quite {w} words {w} and {insults[0]}xyz {w}") for i, w in enumerate(insults, 1)], "doc_id long, text string")
    short = docs.where(F.length("text") < 500).unionByName(more)

    def slow(text):
        seen, scores = Counter(), []
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            stems = [model.stems[w[:n]] for n in (7, 6, 5, 4, 3) if w[:n] in model.stems]
            raw = model.words.get(w, stems[0] if stems else 0.0)
            scores.append(raw * (0.5 ** seen[w] if raw > model.drift else 1) - model.drift)
            seen[w] += raw > model.drift
        gain = [model.decay * sum(scores[a:b]) - math.log(model.scale * len(scores)) for a, b in slow_segments(scores)] if len(scores) < 60 else None
        return gain and (1 / (1 + math.exp(-(model.logit[0] + model.logit[1] * min(200, sum(max(0, g) for g in gain))))), sum(g > 0 for g in gain))

    rows, tried = toxicity.score(short, model).collect(), 0
    for r in rows:
        want = slow(r.text)
        if want:
            tried += 1
            assert r.toxicity == pytest.approx(want[0], abs=1e-9) and len(r.toxic_passages) == want[1]
    assert tried >= 3 and len(rows) == short.count()


def test_logistic_curve_ends_at_its_optimum():
    rng = np.random.default_rng(12)
    for _ in range(300):
        clean, toxic = int(rng.integers(1000, 30_000)), int(rng.integers(10, 3000))
        x = np.concatenate((np.round(rng.exponential(rng.uniform(0.1, 8), clean)), np.minimum(200, np.round(rng.gamma(2, rng.uniform(1, 60), toxic)))))
        y = np.concatenate((np.zeros(clean), np.ones(toxic)))
        a, b = toxicity._logistic(x, y, np.ones(len(x)))
        p = 1 / (1 + np.exp(-(a + b * x)))
        assert b > 0.01 or x[y == 1].mean() < x[y == 0].mean()
        if b:  # both derivatives of the objective vanish
            assert abs((y - p).sum() - 1e-3 * a) < 0.01 and abs(((y - p) * x).sum() - 0.1 * b) < 0.01
    assert toxicity._logistic(np.array([0.0, 9.0]), np.array([1.0, 0.0]), np.array([50.0, 50.0])) == (0.0, 0.0)


def test_toxicity_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    train = spark.createDataFrame([(i, f"fine {'abcdefghij'[i % 10] * (i + 2)} words only" if i % 2 == 0 else f"you idiot {'abcdefghij'[i % 10] * (i + 2)} you") for i in range(40)], "doc_id long, text string")
    model = toxicity.fit(train, labels)
    got = {(r.doc_id, r.text): r for r in toxicity.score(odd, model).collect()}
    assert got[1, None].toxicity == got[2, ""].toxicity < 0.5 and got[4, LONG].toxicity == got[5, LONG].toxicity and toxicity.score(odd, model).columns.count("toxicity") == 1
    said = "Fine words, İ only. You IDIOT, you"
    row = toxicity.score(spark.createDataFrame([(1, said)], "doc_id long, text string"), model).first()
    assert row.toxicity > 0.5 and "idiot" in said.lower()[row.toxic_passages[0].start : row.toxic_passages[0].end]
    assert toxicity.score(odd, toxicity.fit(train, labels.limit(0))).agg(F.max("toxicity")).first()[0] < 1e-9
    assert toxicity.score(odd.limit(0), model).count() == 0


# ---- 2 and 6 vector search


def brute(ids, vectors, asked, k):
    out = {}
    for i, q in zip(ids[asked], vectors[asked]):
        order = np.lexsort((ids, -(vectors @ q)))
        out[i] = [int(ids[j]) for j in order if ids[j] != i][:k]
    return out


def test_hnsw_recall_and_exact_scores(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    vectors = np.stack(e.embedding.values).astype(float)
    got = queries.op2_hnsw(spark, SF).toPandas()
    want = brute(e.vec_id.values, vectors, e.vec_id.values % 20 == 0, 20)
    assert np.mean([len(set(want[i]) & set(g.vec_id)) / 20 for i, g in got.groupby("query_id")]) > 0.95
    at = dict(zip(e.vec_id, vectors))
    assert np.allclose(got.score, [at[a] @ at[b] for a, b in zip(got.query_id, got.vec_id)], rtol=0, atol=1e-12)


def test_hnsw_recall_over_a_full_shard_of_hard_vectors():
    """Independent normal components in 64 dimensions: no clusters to follow."""
    rng, n = np.random.default_rng(3), 16_384
    vectors, ids = rng.normal(size=(n, 64)), np.arange(n)
    index = unpack_arrays(hnsw.build(ids, vectors))
    asked = ids[::80]
    want = brute(ids, vectors, np.isin(ids, asked), 20)
    q, v, _ = hnsw.search(index, asked, vectors[asked], 20, hnsw.beam_for(n))
    recall = [len(set(want[i]) & set(v[q == i].tolist())) / 20 for i in asked.tolist()]
    assert np.mean(recall) >= 0.95


def test_shards_grow_with_the_table(spark):
    one = spark.createDataFrame([(64,)], "dim int")
    assert [vectors.shard_size(one, n) for n in (10, 10**6, 2 * 10**6)] == [16_384, 16_384, 2 * 10**6 // 64]
    assert vectors.shard_size(one, 10**10) <= vectors.MOST_SHARD


def test_hnsw_over_many_shards_and_copies(spark):
    rng = np.random.default_rng(1)
    vectors = np.concatenate((rng.normal(size=(700, 16)), np.repeat(rng.normal(size=(1, 16)), 300, 0)))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = hnsw.neighbours(frame, frame.where("vec_id % 20 = 0"), shard_rows=200).toPandas()
    vectors = vectors.astype(np.float32).astype(float)
    want = brute(np.arange(1000), vectors, np.arange(1000) % 20 == 0, 20)
    assert np.mean([len(set(want[i]) & set(g.vec_id)) / 20 for i, g in got.groupby("query_id")]) > 0.95
    assert got.query("query_id == 720").sort_values("rank").vec_id.tolist() == want[720]  # ties to smaller ids


ODD_VECTORS = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (40, None), (50, [1.0, None]), (60, [float("nan"), 1.0]), (70, [float("inf"), 1.0]), (80, []), (100, [3.0, -1.0]), (100, [3.0, -1.0]), (150, [1.0, 2.0]), (200, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]


def test_vectors_of_odd_tables(spark, tmp_path):
    frame = spark.createDataFrame([(*r, 1) for r in ODD_VECTORS], "vec_id long, embedding array<float>, score int")
    sf = sf_dir(tmp_path, embeddings=frame)
    assert [tuple(r) for r in queries.op2_hnsw(spark, sf).orderBy("query_id", "rank").collect()] == [(0, 1, 150, 5.0), (0, 2, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 150, 1.0)]
    whole = [tuple(r) for r in queries.op6_kdtree(spark, sf).orderBy("query_id", "rank").collect()]
    assert whole == [(0, 1, 150, 327680), (0, 2, 100, 65536), (0, 3, 20, 0), (100, 1, 0, 65536), (100, 2, 150, 65536), (100, 3, 20, 0), (150, 1, 0, 327680), (150, 2, 100, 65536), (150, 3, 20, 0)]
    empty = sf_dir(tmp_path / "e", embeddings=frame.limit(0))
    assert queries.op2_hnsw(spark, empty).count() == queries.op6_kdtree(spark, empty).count() == 0


@pytest.mark.parametrize("shard_rows", [100, 16_384])
def test_kdtree_is_exact(spark, shard_rows):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-4, 5, (600, 5)).astype(float)  # many ties
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = kdtree.top_k(frame, frame.where("vec_id % 50 = 0"), shard_rows=shard_rows).orderBy("query_id", "rank").toPandas()
    assert got.groupby("query_id").vec_id.apply(list).to_dict() == brute(np.arange(600), vectors, np.arange(600) % 50 == 0, 5)


@pytest.mark.parametrize("shard_rows", [40, 16_384])
def test_kdtree_is_exact_beyond_double_precision(spark, tmp_path, shard_rows):
    rng = np.random.default_rng(7)
    vectors = np.concatenate((rng.integers(-9, 10, (100, 4)), rng.integers(-(2**33), 2**33, (100, 4)), 2**33 + rng.integers(-3, 4, (50, 4)))).astype(float)
    rows = list(enumerate(vectors.tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in kdtree.top_k(frame, frame.where("vec_id % 50 = 0"), shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((int(r.score), r.vec_id))
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    assert got == {i: sorted(((dot(q, v), j) for j, v in rows if j != i), key=lambda x: (-x[0], x[1]))[:5] for i, q in rows if i % 50 == 0}


def test_kdtree_query_of_large_components(spark, tmp_path):
    rows = [(0, [4e6, 1.5]), (50, [4e6, -2.25]), (51, [3e38, 1.0]), (52, [-3e38, 1.0]), (53, [1.0, float("inf")])]
    sf = sf_dir(tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in queries.op6_kdtree(spark, sf).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 51, 2**63 - 1), (0, 2, 50, 1024000000**2 - 384 * 576), (0, 3, 52, -(2**63)), (50, 1, 51, 2**63 - 1), (50, 2, 0, 1024000000**2 - 384 * 576), (50, 3, 52, -(2**63))]


def test_kdtree_boxes_are_tight():
    points = np.random.default_rng(3).normal(size=(1000, 4))
    tree = unpack_arrays(kdtree.build(np.arange(1000), points))
    for (a, b, _, _), lo, hi in zip(tree["nodes"], tree["low"], tree["high"]):
        assert (tree["points"][a:b].min(0) == lo).all() and (tree["points"][a:b].max(0) == hi).all()


# ---- 3 mixing


def test_mix_meets_targets(spark, docs):
    got = queries.op3_mixing(spark, SF).toPandas().merge(docs[["doc_id", "source", "text"]], on="doc_id")
    import re

    assert (got["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in got.text]).all()
    by = got.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), small=("size", "min"))
    assert (by["size"] == by.source_size).all() and abs(by.target.sum() - by["size"].sum()) < 1e-3
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(by.index))}
    free = by[by.target < 3 * by["size"] - 1e-6]
    assert free.target.div([weight[s] for s in free.index]).round(6).nunique() == 1
    assert ((by.taken - by.target).abs() <= 0.02 * by.target + 50).all() and (got.taken <= 3 * got["size"]).all()
    again = queries.op3_mixing(spark, SF).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()


def test_targets_stop_at_three_times(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 100)], "source string, words long")
    got = {r.source: r for r in mixing.targets(sources).collect()}
    assert [got[s].weight for s in ("a", "b", "c", None)] == [1, 2, 3, 1]
    assert got["b"].target == got["c"].target == 30 and got[None].target == 300 and got["a"].target == pytest.approx(760)


def slow_multiplier(sizes, target):
    """The multiplier of a source by bisection over its documents."""
    low, high = -60.0, np.log(3)
    for _ in range(200):
        mid = (low + high) / 2
        if (sizes * np.minimum(3, np.exp(np.minimum(mid * sizes, 2.1)))).sum() < target:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def test_mix_against_brute_force(spark):
    """Rates by bisection, copies from the places of a source's documents."""
    sf, exact = "/root/testdata/sf0.01", 0
    kinds = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    frame = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "source", "text")
    chance = {r.id: r.u for r in frame.select("id", mixing._chance(mixing._content(frame), F.lit(0), F.lit(1)).alias("u")).collect()}
    for _, g in kinds.groupby("source"):
        sizes, target = g["size"].to_numpy(float), g.target.iloc[0]
        rates = np.minimum(3, np.exp(np.minimum(slow_multiplier(sizes, target) * sizes, 2.1))) if target < 3 * sizes.sum() else np.full(len(g), 3.0)
        assert (sizes * rates).sum() == pytest.approx(target, rel=1e-6)
        copies, missed, held = np.ones(len(g)), 0.0, {}
        for c in sorted({int(x).bit_length() for x in sizes if x}, reverse=True):  # longest first
            mine = [i for i in range(len(g)) if int(sizes[i]).bit_length() == c]
            place = {(i, j): int((chance[g.doc_id.iloc[i]] + j - rates[i] + 3) * mixing.BINS) for i in mine for j in range(3)}
            wish = missed + sum(sizes[i] * rates[i] for i in mine)
            cuts = [0, *(x + 1 for x in sorted(set(place.values())))]
            words = [sum(sizes[i] for (i, j), at in place.items() if at < x) for x in cuts]
            best = int(np.argmin(np.abs(np.array(words) - wish)))
            missed = wish - words[best]
            held[c] = [best, cuts, words, place, mine]
        if abs(missed) > target / 1000:  # two classes more have changed: copies still follow the places in each class
            assert abs(g.taken.sum() - target) < abs(missed)
            got = (g.taken / g["size"].clip(lower=1)).to_numpy()
            for _, _, _, place, mine in held.values():
                took = [place[i, j] for i in mine for j in range(3) if j < got[i]]
                assert max(took, default=-1) <= min((place[i, j] for i in mine for j in range(3) if j >= got[i]), default=10**9)
            continue
        exact += 1
        for best, cuts, _, place, mine in held.values():
            copies[mine] = [sum(place[i, j] < cuts[best] for j in range(3)) for i in mine]
        assert (g.taken == copies * sizes).all()
    assert exact >= 10


def test_mix_meets_targets_with_null_and_repeated_ids(spark):
    words = lambda n, x: " ".join([x] * n)
    rows = [(None, "a", words(8, "n"))] * 1000 + [(7, "b", words(5, "b"))] * 300 + [(i, "c", words(3 + i % 40, f"c{i}")) for i in range(400)] + [(9, None, words(1 + i, "d")) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(frame).toPandas()
    assert len(got) == len(rows)
    by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), words=("size", "sum"), longest=("size", "max"))
    assert (abs(by.taken - by.target) <= by.longest).all() and (got.taken <= 3 * got["size"]).all()
    again = mixing.resample(frame.repartition(7)).toPandas()
    for source, g in again.groupby("source", dropna=False):
        assert g.text.str.split().str.len().sum() == (by.taken[by.index.isna()].iloc[0] if source is None or source != source else by.taken[source])


def test_equal_rows_are_repeated_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 10)
    frame = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10), ("d", 25)], "x string, n long")
    got = mixing._each(frame, F.col("n")).groupBy("x").agg(F.sort_array(F.collect_list("j")).alias("j")).collect()
    assert {r.x: r.j for r in got} == {"b": [0], "c": list(range(10)), "d": list(range(25))}


def test_mix_of_odd_tables(spark, odd):
    got = mixing.mix(odd).toPandas()
    assert len(got) == odd.count() and got.taken.le(3 * got["size"]).all() and got["size"].tolist().count(0) == 3
    again = mixing.resample(odd)
    assert again.columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0 and mixing.resample(odd.limit(0)).count() == 0
    copies = got.groupby("size").copies.sum().to_dict()
    assert again.groupBy("text").count().where("text = 'a'").select("count").first()[0] == copies[1]


# ---- 4 HTML


def test_html_keeps_the_article_alone():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><div class="menu">Home <a href=x>About</a></div>
      <div class="cookie-notice">We use cookies</div><div id="content"><h2>A  title</h2><p>A long paragraph &eacute;xplains <b>th</b>ings &amp; more, at good length.<div class=ad>Buy now</div>
      <p>Short.<p>Another one follows with <a href="a>b">a link</a> inside.<br>x<br/>y 1 < 2</div><aside>Side</aside><section class="comments"><p>A reader wrote this at length, many words.</p></section>
      <form><label>Mail</label></form><footer>&copy; z</footer><script>if (a<b) x="</p>"</script></body></html>"""
    assert html_extract.main_text(page) == "A title A long paragraph éxplains things & more, at good length. Short. Another one follows with a link inside. x y 1 < 2"


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a</p><!-- open", "a"), ("<nav>x</nav>", ""), ("<p>a&nbsp;&#x62;</p>" * 2, "a b a b"), ("<div " * 3, ""), ("<p>" + "w " * 100_000, ("w " * 100_000).strip())])
def test_html_of_odd_pages(html, text):
    assert html_extract.main_text(html) == text


def test_html_query_against_another_parser(spark):
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.on, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.on += tag == "article"
            if tag != "b":
                self.out.append(" ")

        def handle_endtag(self, tag):
            self.on -= tag == "article"
            if tag != "b":
                self.out.append(" ")

        def handle_data(self, data):
            if self.on:
                self.out.append(data)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op4_html(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        p = Article()
        p.feed(pages[r.page_id])
        assert r.text == " ".join("".join(p.out).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize("inner, text", [
    ("<p>{p}</p><ul>" + "".join(f"<li><a href=x>link {i}</a></li>" for i in range(5)) + "</ul><p>{p}</p>", "{p} link 0 link 1 link 2 link 3 link 4 {p}"),
    ("<p>{p}</p><aside><p>a</p><p>b</p><p>c</p><p>d</p></aside><p>Fifteen letters</p><p>And that is it.</p>", "{p} Fifteen letters And that is it."),
    ("<h1>Title</h1><p><a href=x>by one</a></p><p><a href=x>in that</a></p><p><a href=x>on this</a></p><p>{p}</p>", "Title by one in that on this {p}")])
def test_html_keeps_all_of_an_article(inner, text):
    long = "a long paragraph of words " * 4 + "ends"
    page = f"<body><nav><p>Home</p></nav><p>outside</p><article>{inner.replace('{p}', long)}</article><p>{long}</p></body>"
    assert html_extract.main_text(page) == text.replace("{p}", long)


@pytest.mark.parametrize("head", ["<header class='entry-header'><h1>Title</h1></header>", "<header><h1 class=entry-title><a href=x>Title</a></h1></header>", "<h2><a href=x>Title</a></h2>", "<header id=header class='article-header masthead'><h1>Title</h1></header>"])
@pytest.mark.parametrize("end", ["<p>{p}</p>", "<p>{p}</p>" + "<p><a href=x>l</a></p>" * 3 + "<p>End.</p>", "<div class='search-results'><p>{p}</p></div>"])
def test_html_keeps_the_heading_and_the_end_of_an_article(head, end):
    long = "a long paragraph of words " * 4 + "ends"
    want = "Title " + {"<p>{p}</p>": long}.get(end, f"{long} l l l End." if "End." in end else long)
    for tag in ("article", "main"):
        assert html_extract.main_text(f"<body><header class=site><h1>Site</h1></header><{tag}>{head}{end.replace('{p}', long)}</{tag}><footer>z</footer></body>") == want


@pytest.mark.parametrize("mark", ["class='layout no-sidebar'", "class='content has-sidebar'", "class=page-with-side-nav", "id=search-results", "class=social-science", "class=sidebar", "id='widget-2'"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_html_names_around_all_text_do_not_drop_it(mark, tag):
    long = "a long paragraph of words " * 4 + "ends"
    assert html_extract.main_text(f"<body><div class=site-footer>foot</div><div {mark}><{tag}><p>{long}</p></{tag}></div></body>") == long


@pytest.mark.parametrize("mark", ["class='box site-footer'", "class=comment-list", "id=related-posts", "class=ad1", "role=navigation", "class='sidebar--left'"])
def test_html_names_drop_what_they_name(mark):
    long = "a long paragraph of words " * 4 + "ends"
    assert html_extract.main_text(f"<body><div><p>{long}</p></div><div {mark}><p>{long}</p></div></body>") == long
    assert html_extract.main_text(f"<body><article><p>{long}</p><div {mark}><p>{long}</p></div></article></body>") == long


def test_html_of_odd_tables(spark):
    frame = spark.createDataFrame([(1, "u", "<p>a</p>", "t", 5), (1, None, None, "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((r.text, r.n_chars) for r in html_extract.extract(frame).collect()) == [("", 0), ("a", 1)]
    assert html_extract.extract(frame.limit(0)).count() == 0


# ---- 5 licenses


def slow_scan(text, threshold=0.8):
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    own, out = grams(words(text)), {}
    for name, notice in licenses.NOTICES.items():
        want = set(grams(words(notice)))
        if own and max(len(want & set(own[i : i + len(want)])) for i in range(len(own))) / len(want) >= threshold:
            out[name] = True
    return set(out)


def test_license_query_against_brute_force(spark, docs):
    got: dict[int, set] = {}
    for r in queries.op5_licenses(spark, SF).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
        assert r.containment >= 0.8
    assert got == {i: found for i, t in zip(docs.doc_id, docs.text) if (found := slow_scan(t))}


def test_licenses_of_odd_texts(spark, odd):
    mit, mpl = licenses.NOTICES["MIT"], licenses.NOTICES["MPL-2.0"]
    edited = mpl.replace("can obtain one", "may obtain one")
    rows = [(1, "x " * 50_000 + mit.upper() + " y", 0), (2, edited, 0), (2, edited, 0), (3, None, 0), (4, "the mit license", 0), (5, (mit + " ") * 3, 0)]
    got = sorted((r.doc_id, r.license, r.start_word, round(r.containment, 2)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license int")).collect())
    assert got[0] == (1, "MIT", 50_000, 1.0) and got[1][:3] == got[2][:3] == (2, "MPL-2.0", 0) and 0.8 <= got[1][3] < 1 and got[3][:3] == (5, "MIT", 0) and len(got) == 4
    assert licenses.scan(odd).count() == licenses.scan(odd.limit(0)).count() == 0


# ---- 7 packing


def test_packing_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*e.ids, 0] for i, e in zip(docs.doc_id, tokenizer.encode_batch([t or "" for t in docs.text], add_special_tokens=False))}
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), with_ids=True).toPandas()
    assert got.sequence_id.is_unique and (got.offset == 0).all() and got.length.map(lambda n: n & (n - 1) == 0 and n <= 1024).all()
    for i, g in got.sort_values("start").groupby("doc_id"):
        assert [x for ids in g.ids for x in ids] == want[i] and g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and (g.doc_tokens == len(want[i])).all()
        assert [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in g.ids] == g.ids_crc32.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x250, exclude_categories=["Cs"]) | st.sampled_from(" \n\t'’<|>09aé中"), max_size=60))
def test_fast_splitter_equals_the_tokenizer(text):
    global _ENCODER
    try:
        encoder = _ENCODER
    except NameError:
        encoder = _ENCODER = packing.Encoder()
    assert encoder._plain(text) == encoder._ids(text)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "x<|endoftext|", "  <|endoftext|>\u4e2d <|ENDOFTEXT|>", ""])
def test_added_tokens_have_their_own_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder()(text), "<u4").tolist() == want


def test_pieces_leave_in_buckets_of_one_length(spark, docs, tmp_path, monkeypatch):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack(frame, with_ids=True)
    lengths = [r.length for r in pieces.coalesce(1).collect()]
    assert sum(a != b for a, b in zip(lengths, lengths[1:])) <= 11 * frame.rdd.getNumPartitions()
    got = pieces.toPandas().sort_values("sequence_id")
    assert got.length.is_monotonic_increasing and got.sequence_id.is_unique
    packing.write_buckets(pieces, f"{tmp_path}/b")
    back = spark.read.parquet(f"{tmp_path}/b")
    assert sorted(int(p.name.split("=")[1]) for p in tmp_path.glob("b/length=*")) == sorted(got.length.unique())
    read = back.toPandas().sort_values("sequence_id")
    assert read.sequence_id.tolist() == got.sequence_id.tolist() and [len(x) for x in read.ids] == read.length.tolist() == got.length.tolist()


def test_packing_of_odd_tables(spark, odd):
    got = packing.pack(odd).toPandas()
    assert got.sequence_id.is_unique and got.query("doc_id == 1")[["start", "length", "doc_tokens"]].values.tolist() == [[0, 1, 1]]
    assert got.query("doc_id == 3").length.tolist() == [2, 2] and packing.pack(odd.limit(0)).count() == 0
    assert packing.binary_pieces(2061, 1024) == [(0, 1024), (1024, 1024), (2048, 8), (2056, 4), (2060, 1)]


# ---- 8 SimHash


def slow_fingerprint(text, width=3):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, distance=3):
    name = {i: i for i in ids}
    find = lambda x: x if name[x] == x else find(name[x])
    for (a, x), (b, y) in combinations(zip(ids, fps), 2):
        if (x ^ y).bit_count() <= distance:
            low, high = sorted((find(a), find(b)))
            name[high] = low
    return {i: find(i) for i in ids}


def test_simhash_query_against_brute_force(spark, docs):
    got = {r.doc_id: r for r in queries.op8_simhash(spark, SF).collect()}
    fps = [slow_fingerprint(t) for t in docs.text]
    assert [got[i].fingerprint for i in docs.doc_id] == [f"{x:016x}" for x in fps]
    assert {i: r.component_id for i, r in got.items()} == slow_components(docs.doc_id.tolist(), fps)


@pytest.mark.parametrize("limit", [3, 4096])
def test_links_connect_what_brute_force_connects(spark, limit):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres[:6]:  # hot buckets: many within a few bits of one another
        for _ in range(60):
            fps.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    pairs = [(r.a & 2**64 - 1, r.b & 2**64 - 1) for r in simhash.similar_links(frame, bucket_limit=limit).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    name = {x: x for x in fps}
    find = lambda x: x if name[x] == x else find(name[x])
    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        name[high] = low
    assert {x: find(x) for x in fps} == slow_components(fps, fps)


def slow_jaccard(a, b, width=5):
    def grams(text):
        words = (text or "").encode().lower().split()
        return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def edited():
    """(id, text) of texts with copies about 0.93 and 0.87 and under 0.75 similar, those of one base hanging together through it alone."""
    rng = np.random.default_rng(11)
    out = []
    for base in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        out.append(words)
        for edits in (2, 4, 10, 20, 40):
            copy = list(words)
            for at in rng.choice(300, edits, replace=False):
                copy[at] = f"x{rng.integers(0, 10**9)}"
            out.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("limit", [3, 32_768])
def test_resemblance_links_what_brute_force_links(spark, edited, limit):
    same = {(i, j): slow_jaccard(a, b) for (i, a), (j, b) in combinations(edited, 2)}
    frame = simhash.with_fingerprints(spark.createDataFrame(edited, "id long, text string"), "text", ["id"], 5, True).select(F.col("id").alias("node"), "s.*")
    links = [tuple(sorted(r)) for r in resemblance.similar_texts(frame, 0.8, limit).collect()]
    assert all(same[x] > 0.74 for x in links)  # four standard deviations of a sketch
    assert reached(edited, links) == reached(edited, [x for x, s in same.items() if s >= 0.86 or x in links])
    assert sum(s >= 0.86 for s in same.values()) >= 70


def reached(rows, links):
    name = {i: i for i, _ in rows}
    find = lambda x: x if name[x] == x else find(name[x])
    for a, b in links:
        low, high = sorted((find(a), find(b)))
        name[high] = low
    return {i: find(i) for i in name}


def test_edited_copies_go_and_others_stay(spark, edited):
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(edited, "doc_id long, text string")).collect()}
    for at in range(0, len(edited), 6):
        base = [slow_jaccard(edited[at][1], edited[at + k][1]) for k in range(1, 6)]
        assert at in kept and all((at + k + 1 in kept) == (s < 0.8) for k, s in enumerate(base) if abs(s - 0.8) > 0.06)


def test_near_copies_are_decided_at_0_8_exactly(spark):
    rng, out = np.random.default_rng(21), []
    for k, pairs in ((10, 80), (11, 80)):  # 94 words, of which k differ: similarity 80/100 and 79/101
        for _ in range(pairs):
            words = [f"v{x}" for x in rng.integers(0, 10**9, 94 + k)]
            out += [words[:94], words[: 94 - k] + words[94:]]
    rows = [(i, " ".join(w)) for i, w in enumerate(out)]
    fps = [slow_fingerprint(t, 5) for _, t in rows]
    same = [slow_jaccard(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2)]
    assert same == [80 / 100] * 80 + [79 / 101] * 80
    gone = {i + 1 for i in range(0, len(rows), 2) if same[i // 2] >= 0.8 or (fps[i] ^ fps[i + 1]).bit_count() <= 3}
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows} - gone


def test_texts_of_one_fingerprint_keep_their_own_links(spark):
    words = lambda seed: " ".join(f"u{x}" for x in np.random.default_rng(seed).integers(0, 10**9, 100))
    line = "one line of seven words comes again "
    rows = []
    for seed in range(0, 16, 2):  # pairs of one fingerprint, and the own words of each alone
        rows += [line * 400 + words(seed), line * 400 + words(seed + 1), words(seed), words(seed + 1)]
    rows = list(enumerate(rows))
    fps = [slow_fingerprint(t, 5) for _, t in rows]
    assert len({f for f, (i, _) in zip(fps, rows) if i % 4 < 2}) == 1
    links = [(i, j) for (i, x), (j, y) in combinations(rows, 2) if (fps[i] ^ fps[j]).bit_count() <= 3 or slow_jaccard(x, y) >= 0.8]
    got = {r.id: r.component for r in simhash.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "text", "id", 5, 3, 0.8).collect()}
    assert got == reached(rows, links) == {i: 0 for i, _ in rows}


def test_families_of_all_sizes_are_compared_whole(monkeypatch):
    monkeypatch.setattr(resemblance, "SPOOL_BYTES", 64)
    monkeypatch.setattr(resemblance, "COMPARE", 10)
    rng, sets = np.random.default_rng(3), resemblance.Sets()
    made = [set(rng.choice(40, rng.integers(1, 40), replace=False).tolist()) for _ in range(60)]
    for x in made:
        sets.add([*x, *x])
    for at in (0, 17, 59):
        assert sets.alike(0.5, at, np.arange(60)).tolist() == [len(made[at] & x) / len(made[at] | x) >= 0.5 for x in made]


def test_plans_cover_every_pair():
    rng = np.random.default_rng(5)
    for rows in (10, 10**6, 10**10):
        masks = simhash.plan([int(x) for x in rng.integers(0, 2**63, 300, dtype=np.uint64)], rows)
        assert sum(t + 1 for _, t in masks) == 4 and all(a & b == 0 for (a, _), (b, _) in combinations(masks, 2))
    assert len(simhash.plan([0], 10**10)) >= 1


def test_simhash_of_odd_tables(spark, odd):
    got = {(r.doc_id, r.component) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (7, 1), (3, 3), (4, 4), (5, 4), (6, 6), (None, 6)} <= got
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "8"]
    assert simhash.representatives(odd.limit(0)).count() == 0
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_no_text_goes_without_a_copy_that_stays(spark):
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abce")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (9, c, 5), (9, e, 6), (9, e, 6), (None, c, 7), (None, "quite another text", 8), (None, "quite another text", 8), (4, None, 9), (2, "", 10)]
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(rows)).tolist()
        frame = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string, __key int").repartition(3)
        kept = sorted(map(str, map(tuple, simhash.representatives(frame).collect())))
        assert kept == sorted(map(str, [(3, a, 1), (5, b, 3), (9, c, 5), (9, e, 6), (None, "quite another text", 8), (2, "", 10)]))


@pytest.mark.parametrize("low, high", [(0.8, 0.85), (0.85, 0.95)])
def test_near_copies_are_caught(spark, low, high):
    rng, rows = np.random.default_rng(31), []
    while len(rows) < 240:
        words = [f"v{x}" for x in rng.integers(0, 3000, rng.integers(40, 400))]
        copy = list(words)
        for at in rng.choice(len(words), max(1, int(rng.uniform(0.005, 0.05) * len(words))), replace=False):
            copy[at] = f"z{rng.integers(0, 10**9)}"
        if low <= slow_jaccard(" ".join(words), " ".join(copy)) < high:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(i in kept for i, _ in rows[::2]) and sum(i in kept for i, _ in rows[1::2]) <= 0.1 * len(rows) / 2


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 90)] + [(5, 5), (7, 6), (None, 3)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(90)}}


# ---- 9 sharding


def slow_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_its_definition():
    keys = np.random.default_rng(6).integers(0, 2**64, 500, dtype=np.uint64)
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]


def test_sharding_query(spark, docs):
    got = queries.op9_sharding(spark, SF).toPandas()
    text = dict(zip(docs.doc_id, docs.text))
    assert (got["size"] == [len(text[i].encode()) + 16 for i in got.doc_id]).all() and (got.text_crc32 == [zlib.crc32(text[i].encode()) for i in got.doc_id]).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    key = {i: xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42) for i in got.doc_id}
    assert [slow_jump(key[i], 40) for i in got.doc_id] == got["shard"].tolist() and [slow_jump(key[i], 41) for i in got.doc_id] == got.grown_shard.tolist()
    moved = got[got["shard"] != got.grown_shard]
    assert (moved.grown_shard == 40).all() and len(moved) < 0.1 * len(got)


def test_equal_rows_get_slots_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    rows = [(1, "a")] * 50 + [(2, "b")] * 7 + [(None, None)] * 15 + [(i, "c") for i in range(40)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas()
    assert len(got) == len(rows) and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_sharding_of_odd_tables(spark, odd):
    got = sharding.shard(odd, 3).toPandas()
    assert len(got) == odd.count() and sharding.shard(odd.limit(0)).count() == 0
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got[got.doc_id == 1].values.tolist()[0][1:3] == [16, 0] and got[got.doc_id == 3]["shard"].nunique() == 1


# ---- 10 chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "to:ol\n### "]), st.text(st.sampled_from("\\#</turn>:a @\n é"), max_size=30)), max_size=6))
def test_chat_round_trip(turns):
    assert chat.read("".join(chat.render(r, t)[0] for r, t in turns)) == turns


def test_chat_query_against_the_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    got = queries.op10_chat(spark, SF).toPandas().set_index("conv_id")
    said = r"\### Assistant: </turn> ok"
    rows = pd.concat([rows, pd.DataFrame({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [said] * 2})])
    assert len(got) == rows.conv_id.nunique()
    for i, g in rows.groupby("conv_id"):
        loss = "".join(g.text[g.role == "assistant"])
        assert got.turns_sha256[i] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text)).encode()).hexdigest()
        assert (got.n_turns[i], got.loss_chars[i], got.loss_sha256[i]) == (len(g), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_query_folds_events(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (None, 2, None, "x"), (None, None, "assistant", r"\### </turn>"), (2, 5, "assistant", "long " * 50_000), (2, 5, "assistant", "b")]
    sf = sf_dir(tmp_path, conversations=spark.createDataFrame([(*r, 1, "m") for r in rows], "conv_id long, turn long, role string, text string, seq int, message string"))
    said = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    events = chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert events.where("message is null").count() == 0 and events.select("message").distinct().count() == len(rows) and events.count() == 2 * len(rows)
    got = {r.conv_id: r for r in queries.op10_chat(spark, sf).collect()}
    for conv in (1, None, 2, -7):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows + said if c == conv), key=lambda y: (y[0] is not None, y[0] or 0, y[1:]))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = sf_dir(tmp_path / "e", conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").limit(0))
    assert [r.conv_id for r in queries.op10_chat(spark, empty).collect()] == [-7]


def test_events_without_a_message_id(spark):
    log = [(1, 0, "delta", None, "user", "d"), (1, 1, "edit", None, "user", "e"), (1, 2, "regenerate", None, None, None), (1, 3, "delete", None, None, None), (1, 4, "message", None, "user", "m"), (1, 5, None, None, "user", "?")]
    events = spark.createDataFrame(log, "conv_id long, seq long, event string, message string, role string, text string")
    assert sorted(tuple(r) for r in chat.fold(events).collect()) == [(1, 0, "user", "d"), (1, 1, "user", "e"), (1, 4, "user", "m")]


def test_events_fold_into_final_messages(spark):
    log = [(1, 0, "message", "a", "user", "hi"), (1, 1, "message", "b", "assistant", ""), (1, 2, "delta", "b", None, "he"), (1, 4, "delta", "b", None, "llo"), (1, 3, "edit", "a", None, "hi!"),
           (1, 5, "regenerate", "b", None, None), (1, 6, "delta", "b", None, "good day"), (1, 7, "message", "c", "user", "x"), (1, 8, "delete", "c", None, None), (2, 0, "message", None, "user", None), (None, None, "message", None, None, "n"), (1, 9, "typing", "a", None, "?")]
    events = spark.createDataFrame(log, "conv_id long, seq long, event string, message string, role string, text string")
    got = sorted(((r.conv_id or -1, r.seq, r.role, r.text) for r in chat.fold(events).collect()), key=str)
    assert got == sorted([(-1, None, None, "n"), (1, 0, "user", "hi!"), (1, 1, "assistant", "good day"), (2, 0, "user", None)], key=str)
    parts = chat.format_conversations(chat.fold(events), part_chars=20).collect()
    assert chat.read("".join(p.formatted for p in parts if p.conv_id == 1)) == [("user", "hi!"), ("assistant", "good day")]
    assert [p.formatted[s.start : s.end] for p in parts for s in p.loss] == ["good day"] and chat.digests(chat.format_conversations(chat.fold(events.limit(0)))).count() == 0


def test_cuts_that_nothing_needs_are_removed(spark, docs, tmp_path):
    from ledgerloom.llm import common

    left = lambda: set(p.name for p in __import__("pathlib").Path(common.shared_folder(spark)).glob("cut-*"))
    frame, before = spark.read.parquet(f"{SF}/documents.parquet"), left()
    assert simhash.representatives(frame).count() and len(left() - before) == 1  # who stays
    before = left()
    assert mixing.resample(frame).count() and len(left() - before) == 3  # equal rows, sources and limits
    before = left()
    toxicity.fit_on_labels(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    assert left() == before


# ---- the pipeline


def test_links_of_nothing(spark):
    none = spark.createDataFrame([], "node long, bands array<long>, more array<long>, sketch binary")
    nulls = spark.createDataFrame([(1, None, None, None), (2, None, None, None)], none.schema)
    assert resemblance.similar_texts(none).count() == resemblance.similar_texts(nulls).count() == 0
    assert simhash.similar_links(spark.createDataFrame([], "fp long")).count() == 0 and simhash.similar_links(spark.createDataFrame([(0,)], "fp long")).count() == 0


def test_pipeline_stages_of_odd_tables(spark, odd, tmp_path):
    """Null columns, repeated rows and ids, empty and very long texts and columns that stages make themselves; and tables without rows."""
    columns = odd.columns
    labels = spark.createDataFrame([(i, 0) for i in range(5)] + [(None, 1)], "doc_id long, toxic int")
    for rows, left in ((odd, 9), (odd.limit(0), 0)):
        sf = sf_dir(tmp_path / str(left), labels=labels if left else labels.limit(0), documents=rows)
        frame = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = spark.createDataFrame(stage(spark, frame, sf).collect(), odd.schema)
            assert frame.columns == columns
            if name == "toxicity":
                assert frame.count() == rows.count()  # nothing there is toxic
            if name == "simhash":  # one for each text: nothing, a, the long one, some words and one of its own
                assert sorted(r.doc_id for r in frame.collect()) == ([1, 3, 4, 6, 8] if left else [])
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
        assert packed.where("start = 0").count() == frame.count() and corpus_pipeline.run(spark, sf).count() == packed.count()


def test_pipeline_against_its_stages(spark, docs):
    frame, steps = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
        steps[name] = frame.toPandas()
        frame = spark.createDataFrame(steps[name]) if name != "packing" else frame
    columns = docs.columns.tolist()
    assert all(steps[n].columns.tolist() == columns for n in ("toxicity", "simhash", "mixing"))
    clean = steps["toxicity"]
    fps = [slow_fingerprint(t, 5) for t in clean.text]
    texts = list(zip(clean.doc_id, clean.text))
    links = [(a, b) for ((a, x), p), ((b, y), q) in combinations(zip(texts, fps), 2) if (p ^ q).bit_count() <= 3 or slow_jaccard(x, y) >= 0.8]
    assert sorted(steps["simhash"].doc_id) == sorted(set(reached(texts, links).values()))
    assert max(Counter(steps["mixing"].doc_id).values()) <= 3 and set(steps["mixing"].doc_id) <= set(steps["simhash"].doc_id)
    packed = steps["packing"]
    assert Counter(packed[packed.start == 0].doc_id) == Counter(steps["mixing"].doc_id)
    assert packed.length.sum() == packed[packed.start == 0].doc_tokens.sum()
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
