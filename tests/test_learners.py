"""Boosted trees and linear classifiers: against plain loops, over one part and over several, and on held-out rows."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators import boosting as bo
from faultline.operators import linear as li
from faultline.operators import ml
from faultline.operators.evaluation import robust_effect
from faultline.session import materialize


def planted(spark, n=1500, width=8, seed=0):
    """The label follows from feature 0, from feature 1 missing and from the product of 2 and 3."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[5, 4], x[6, 4] = np.inf, -np.inf
    z = 1.5 * np.nan_to_num(x[:, 0]) + np.where(np.isnan(x[:, 1]), 2, 0) + np.nan_to_num(x[:, 2] * x[:, 3])
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    rows = [(i, int(y[i]), [None if i % 7 == 0 and math.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    return materialize(spark.createDataFrame(rows, "id long, y int, x array<double>")), x, y


def auc(y, p):
    a, b = p[y == 1], p[y == 0]
    return ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2) if len(a) and len(b) else None


SMALL = bo.Settings(trees=30, depth=4, rate=0.1, subsample=0.85, columns=0.8, child_weight=3, gamma=0.1, alpha=0.1, l2=1.0)


def test_boosted_trees_tell_later_rows(spark):
    df, _, y = planted(spark)
    model = bo.fit_boosted(df.where("id < 1000"), "x", "y", F.lit(1.0), ["id"], 8, SMALL)
    got = df.withColumn("p", model.probability(F.col("x"))).orderBy("id").toPandas()
    assert auc(y[:1000], got.p[:1000].to_numpy()) > 0.85 and auc(y[1000:], got.p[1000:].to_numpy()) > 0.7
    shares = model.importance([f"f{i}" for i in range(8)])
    assert abs(sum(shares.values()) - 1) < 1e-9 and max(shares, key=shares.get) in ("f0", "f1")


def test_parts_grow_the_same_trees(spark):
    df, *_ = planted(spark, 600)
    few = bo.Settings(**{**SMALL.__dict__, "trees": 3})
    one = bo.fit_boosted(df, "x", "y", F.lit(1.0), ["id"], 8, few)
    many = bo.fit_boosted(df, "x", "y", F.lit(1.0), ["id"], 8, few, part_bytes=1200)
    for a, b in zip(one.trees, many.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, atol=1e-12)


def test_best_split_is_the_best_of_all():
    """Every cut and both sides for missing values, tried one after the other."""
    rng = np.random.default_rng(3)
    s = bo.Settings(child_weight=0.5, alpha=0.2, l2=1.3)
    bins = rng.choice([0, 1, 2, 3, bo.MISSING], (80, 3)).astype(np.uint8)
    g, h = rng.normal(size=80), rng.random(80)
    sums = np.zeros((2, 3, 1, 256))
    for j in range(3):
        sums[0, j, 0] = np.bincount(bins[:, j], g, 256)
        sums[1, j, 0] = np.bincount(bins[:, j], h, 256)
    score = lambda a, b: max(abs(a) - s.alpha, 0) ** 2 / (b + s.l2)
    best = -math.inf
    for j in range(3):
        for cut in range(4):
            for missing in (False, True):
                left = np.where(bins[:, j] == bo.MISSING, missing, bins[:, j] <= cut)
                if min(h[left].sum(), h[~left].sum()) >= s.child_weight:
                    best = max(best, score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum()))
    assert abs(bo.best_splits(sums, s)["gain"][0] - best) < 1e-9


def test_bins_and_cuts_agree(spark):
    """A value goes left of a cut exactly when it is not greater."""
    df, x, _ = planted(spark, 400)
    cuts = bo.quantile_cuts(df, "x", 8)
    bins = bo.binned(x, cuts)
    for j, c in enumerate(cuts):
        good = np.isfinite(x[:, j])
        assert (bins[~good, j] == bo.MISSING).all() and all(((x[good, j] <= v) == (bins[good, j] <= k)).all() for k, v in enumerate(c))


def test_no_rows_and_one_class(spark):
    shape = "id long, y int, x array<double>"
    none = bo.fit_boosted(spark.createDataFrame([], shape), "x", "y", F.lit(1.0), ["id"], 2, SMALL)
    assert spark.createDataFrame([(1, 0, [1.0, None])], shape).select(none.probability(F.col("x")).alias("p")).first()["p"] == 0.5
    ones = spark.createDataFrame([(i, 1, [float(i), None]) for i in range(40)], shape)
    assert ones.select(bo.fit_boosted(ones, "x", "y", F.lit(1.0), ["id"], 2, SMALL).probability(F.col("x")).alias("p")).agg(F.min("p")).first()[0] > 0.5


TEXTS = [("a", "The pump, the PUMP failed again", "p"), ("b", "pump failed at night", "q"), ("c", "Network is down; network slow", "p"), ("d", "network down again x", None), ("e", None, "r"), ("f", "", "p")]


def test_vectors_are_tfidf(spark):
    df = spark.createDataFrame(TEXTS, "id string, t string, c string")
    vectors = li.SparseVectors([li.TermPart("t", 100)], ["c"]).fit(df)
    runs = {}
    for i, t, _ in TEXTS:
        w = re.findall(r"\w{2,}", (t or "").lower())
        runs[i] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    seen = Counter(t for r in runs.values() for t in r)
    terms = sorted(t for t, n in seen.items() if n >= 2)
    assert vectors.parts[0].terms == terms and vectors.known == {"c": ["p", "q", "r"]}
    for r in vectors.transform(df).collect():
        weight = {terms.index(t): (1 + math.log(n)) * (math.log((1 + len(TEXTS)) / (1 + seen[t])) + 1) for t, n in runs[r["id"]].items() if t in terms}
        size = math.sqrt(sum(v * v for v in weight.values()))
        want = {k: v / size for k, v in weight.items()} | ({len(terms) + "pqr".index(r["c"]): 1.0} if r["c"] else {})
        assert dict(zip(r["_idx"], r["_val"])).keys() == want.keys() and all(abs(v - want[k]) < 1e-9 for k, v in zip(r["_idx"], r["_val"]))


def test_most_frequent_terms_are_kept(spark):
    df = spark.createDataFrame([("x aa",), ("aa bb",), ("bb aa",), ("bb",), ("cc",), ("cc",)], "t string")
    assert li.TermPart("t", 2).fit(df).terms == ["aa", "bb"]


@pytest.mark.parametrize("kind", ["svc", "logistic"])
@pytest.mark.parametrize("classes", [2, 4])
def test_linear_reaches_the_optimum(spark, kind, classes):
    rng = np.random.default_rng(7)
    rows = [(str(k := int(rng.integers(classes))), sorted(set(int(v) for v in rng.integers(0, 12, 4)) | {k})) for _ in range(200)]
    df = spark.createDataFrame([(lab, idx, [1.0 + i / 9 for i in idx], 1.0 + (n % 3)) for n, (lab, idx) in enumerate(rows)], "label string, _idx array<int>, _val array<double>, w double")
    model = li.fit_linear(df, "label", F.col("w"), 12, kind, 0.7, steps=400, tolerance=1e-7)
    parts = li.fit_linear(df, "label", F.col("w"), 12, kind, 0.7, steps=25, tolerance=1e-7, part_bytes=2_000)
    short = li.fit_linear(df, "label", F.col("w"), 12, kind, 0.7, steps=25, tolerance=1e-7)
    assert np.allclose(parts.weights, short.weights, atol=1e-8)
    dense = np.zeros((200, 13))
    for i, (_, idx) in enumerate(rows):
        dense[i, idx] = [1.0 + j / 9 for j in idx]
    dense[:, 12] = 1
    label, w = np.array([int(r[0]) for r in rows]), np.array([1.0 + n % 3 for n in range(200)])

    def objective(flat):
        weights = flat.reshape(13, -1)
        m = dense @ weights
        free = weights if kind == "svc" else weights[:-1]
        if kind == "svc":
            sign = np.where(label[:, None] == (np.arange(m.shape[1]) if m.shape[1] > 1 else 1), 1, -1)
            loss = (w[:, None] * np.maximum(0, 1 - sign * m) ** 2).sum()
        else:
            loss = (w * (np.log(np.exp(m).sum(1)) - m[np.arange(200), label])).sum()
        return (free**2).sum() / 2 + 0.7 * loss

    best = model.weights.ravel()
    assert model.weights.shape == (13, 1 if kind == "svc" and classes == 2 else classes)
    for _ in range(60):  # no small step in any direction is better
        step = rng.normal(size=best.shape)
        assert objective(best) <= objective(best + 1e-3 * step / np.linalg.norm(step)) + 1e-9
    got = [r["p"] for r in model.transform(df.coalesce(1), "p").collect()]
    m = dense @ model.weights
    assert got == [str(v) for v in ((m[:, 0] > 0).astype(int) if m.shape[1] == 1 else m.argmax(1))]


def test_packed_rows_have_a_fixed_layout(spark):
    columns = list(ml.FEATURE_ENDINGS)
    rows = [("s", 1, m, *[100.0 * i + k for k in range(12)]) for i, m in enumerate(["b", "a", "other"])] + [("s", 2, "a", *[None] * 12)]
    long = spark.createDataFrame(rows, "service string, slot int, metric string, " + ", ".join(f"{c} double" for c in columns))
    got = {r["slot"]: r["features"] for r in ml.packed_rows(long, ["service", "slot"], "metric", ["a", "b"]).collect()}
    names = ml.feature_names(["a", "b"])
    assert len(names) == 24 and names[:4] == ["a", "b", "a__lag_5m", "b__lag_5m"] and got[2] == [None] * 24
    assert [got[1][names.index(n)] for n in ("a", "b", "a__rolling_std_15m", "b__delta_5m")] == [100.0, 0.0, 111.0, 4.0]


def test_effect_ignores_what_is_not_finite(spark):
    rows = [(1, float(v)) for v in range(10, 22)] + [(0, float(v)) for v in range(12)]
    odd = [(1, math.inf), (0, -math.inf), (1, math.nan), (0, math.nan), (0, None)]
    plain, more = (robust_effect(spark.createDataFrame(r, "y int, v double"), [], "y", "v").first().asDict() for r in (rows, rows + odd))
    assert plain == more and plain["n_cases"] == 12 and abs(plain["effect"] - 10 / 5.5) < 1e-12


@pytest.fixture
def split_files(spark):
    """Files are read in splits of 2,000 bytes, as large files are in splits of a few MB."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_part_in_several_splits_is_fitted_whole(split_files):
    rng = np.random.default_rng(4)
    df = materialize(split_files.createDataFrame([([j], [1 + rng.random()], "ab"[j % 2]) for j in map(int, rng.integers(0, 6, 4000))], "_idx array<int>, _val array<double>, y string").coalesce(1))
    for kind in ("svc", "logistic"):
        model = li.fit_linear(df, "y", F.lit(1.0), 6, kind, 1.0)
        assert model.passes > 1 and model.transform(df, "p").where("y <> p").count() == 0


def test_trees_of_one_part_in_several_splits(split_files):
    df, *_ = planted(split_files, 600)
    few = bo.Settings(**{**SMALL.__dict__, "trees": 3})
    model = bo.fit_boosted(df, "x", "y", F.lit(1.0), ["id"], 8, few)
    assert len(model.trees) == 3 and all((t.gain > 0).any() for t in model.trees)
