"""Fits of ticket models: columns of unlike size, and terms counted once for several models."""

import numpy as np
from pyspark.sql import functions as F

from faultline.operators import linear as li
from faultline.operators import ml
from faultline.plans import QUERIES
from faultline.plans import catalog_models as cm


def test_columns_of_unlike_size_need_few_passes(spark):
    rng = np.random.default_rng(2)
    true = rng.normal(size=40)
    rows = [sorted(rng.choice(40, 5, replace=False).tolist()) for _ in range(1500)]
    data = [("ab"[int(true[r].sum() + rng.normal() > 0)], r, [10.0 ** (j % 5 - 1) for j in r]) for r in rows]
    df = spark.createDataFrame(data, "y string, _idx array<int>, _val array<double>")
    exact = li.fit_linear(df, "y", F.lit(1.0), 40, "svc", 1.0, steps=3000, tolerance=1e-9)
    for part_bytes in (li.PART_BYTES, 20_000):
        model = li.fit_linear(df, "y", F.lit(1.0), 40, "svc", 1.0, steps=60, part_bytes=part_bytes)
        assert model.passes < 60 and np.abs(model.weights - exact.weights).max() < 0.02


def test_models_of_the_same_rows_share_their_term_counts(spark):
    rows = [(f"{'pump' if i % 2 else 'fan'} number n{i % 7} {'broke' if i % 2 else 'stopped'}", "ab"[i % 2], "pqr"[i % 3]) for i in range(60)]
    train = spark.createDataFrame(rows, "ticket_text string, type string, queue string")
    counts = ml.shared_counts(train, characters=True)
    for variant in ("v4", "C"):
        alone, shared = ml.train_queue(train, variant), ml.train_queue(train, variant, counts=counts)
        assert [p.terms for p in alone.vectors.parts] == [p.terms for p in shared.vectors.parts]
        assert np.allclose(alone.model.weights, shared.model.weights, atol=1e-3)


def test_linear_models_are_compared_on_all_terms(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(cm, "split", lambda spark, d: (None, None))
    monkeypatch.setattr(ml, "compare_models", lambda train, test, label, kinds, features: asked.update(features))
    QUERIES["g10_compare_models"](spark, "")
    assert asked["svc"] == asked["logistic"] == 30_000


def test_benchmark_splits_and_compares_each_set_once(spark, monkeypatch):
    rows = [(i, f"{'pump broke' if i % 2 else 'fan stopped'} n{i % 9}", "ab"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, ticket_text string, type string")
    overlap, seen = ml.text_overlap, []
    monkeypatch.setattr(ml, "text_overlap", lambda *a: seen.append(1) or overlap(*a))
    out = ml.benchmark({"low": df.where("doc_id < 60"), "high": df.where("doc_id >= 20")}, "type", "doc_id").collect()
    assert len(seen) == 3 and {(r["trained_on"], r["tested_on"]) for r in out} == {(a, b) for a in ("low", "high") for b in ("low", "high")}
    assert all(r["accuracy"] == 1.0 and r["overlap_percent"] > 0 for r in out)
