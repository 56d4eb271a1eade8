"""Exact neighbours and near duplicates against brute force, with hot copy groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import similarity as sim
from faultline.operators.iforest import IsolationForest
from faultline.operators.search import nearest
from faultline.operators.term_buckets import similar_documents


def vectors(n=150, dim=12, copies=50, seed=3):
    """A third of the rows are copies of one vector."""
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(size=(n, dim)))
    x[:copies] = x[0]
    return x


@pytest.fixture(scope="module")
def sample(spark):
    x = vectors()
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return sim.dense_vectors(df, "id", "e"), np.round(unit @ unit.T, 9)


def brute(scores, k):
    out = set()
    for i, row in enumerate(scores):
        order = sorted((j for j in range(len(row)) if j != i), key=lambda j: (-row[j], j))[:k]
        out |= {(i, j) for j in order}
    return out


def test_knn_documents_with_copies(sample):
    vecs, scores = sample
    got = {(r["id"], r["neighbour"]) for r in sim.knn_documents(vecs, 4).collect()}
    assert got == brute(scores, 4)


def test_knn_join_prunes_over_many_blocks(sample):
    vecs, scores = sample
    got = {(r["id"], r["neighbour"]) for r in sim.knn_join(vecs, vecs, 3, block_rows=10).collect()}
    assert got == brute(scores, 3)


def test_topk_similar_both_ways(sample):
    vecs, scores = sample
    small = {(r["id"], r["neighbour"]) for r in sim.topk_similar(vecs, vecs, 3).collect()}
    large = {(r["id"], r["neighbour"]) for r in sim.topk_similar(vecs, vecs, 3, small=10).collect()}
    assert small == large == brute(scores, 3)


@pytest.mark.parametrize("every", [1, 7])
def test_nearest_in_several_chunks_with_copies(sample, every):
    vecs, scores = sample
    asked = vecs.where(F.col("id") % every == 0)
    got = [(r["id"], r["neighbour"], r["rank"]) for r in nearest(asked, vecs.repartition(5), 4, at_once=40).collect()]
    assert {g[:2] for g in got} == {(i, j) for i, j in brute(scores, 4) if i % every == 0}
    assert all(sorted(r for i, _, r in got if i == q) == [1, 2, 3, 4] for q in range(0, len(scores), every))


def test_similar_documents_with_copies_blanks_and_nulls(spark):
    rng = np.random.default_rng(5)
    words = [" ".join(f"w{int(w)}" for w in np.minimum(rng.pareto(0.7, 30) * 3, 60)) for _ in range(60)]
    rows = [(i, "x", words[0] if i % 4 == 0 else words[i]) for i in range(60)] + [(60, "x", None), (70, "x", ""), (80, "x", "alone")]
    texts = spark.createDataFrame(rows, "id long, label string, t string")
    weights = sim.tfidf(texts, "id", sim.tokens(F.col("t")))
    want = sim.knn_documents(sim.vectors(weights, "id"), 5).where("id % 10 = 0")
    key = lambda df: sorted((r["id"], r["neighbour"], r["rank"], round(r["similarity"], 8)) for r in df.collect())
    assert key(similar_documents(texts, 5, 10)) == key(want)
    assert not similar_documents(texts.where("id >= 60"), 5, 10).collect()


@pytest.mark.parametrize("posting", [3, 64])
@pytest.mark.parametrize("limit", [40, 5000])
def test_near_duplicates(sample, limit, posting):
    vecs, scores = sample
    labels = vecs.select("id", (F.col("id") % 3).cast("string").alias("label"))
    got = [(r["i"], r["j"]) for r in sim.near_duplicates(vecs, labels, 0.9, limit, posting).collect()]
    n = len(scores)
    pairs = [(-scores[i, j], i, j) for i in range(n) for j in range(i + 1, n) if i % 3 != j % 3 and scores[i, j] >= 0.9]
    assert sorted(got) == sorted((i, j) for _, i, j in sorted(pairs)[:limit])


def test_isolation_forest_finds_far_points_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(1000 + i, 9.0 + i, -9.0) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    run = lambda: IsolationForest(["a", "b"], "id", trees=40, contamination=0.02).fit(df).transform(df)
    first = {r["id"]: r["anomaly_score"] for r in run().collect()}
    assert {i for i, s in first.items() if s > 0} >= {1000, 1001, 1002, 1003}
    assert first == {r["id"]: r["anomaly_score"] for r in run().collect()}


def test_near_duplicates_stop_at_the_first_threshold_with_enough_pairs(sample, monkeypatch):
    vecs, scores = sample
    labels = vecs.select("id", (F.col("id") % 3).cast("string").alias("label"))
    asked, search = [], sim._similar_pairs
    monkeypatch.setattr(sim, "_similar_pairs", lambda reps, threshold, *more: asked.append(threshold) or search(reps, threshold, *more))
    n = len(scores)
    pairs = sorted((-scores[i, j], i, j) for i in range(n) for j in range(i + 1, n) if i % 3 != j % 3 and scores[i, j] >= 0.9)
    same = sum(s <= -1.0 for s, _, _ in pairs)
    assert same
    got = [(r["i"], r["j"]) for r in sim.near_duplicates(vecs, labels, 0.9, same).collect()]
    assert got == [(i, j) for _, i, j in pairs[:same]] and asked == [1.0]
